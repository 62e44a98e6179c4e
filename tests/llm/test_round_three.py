"""Centroid clustering, the Merkle manifest and the mix of sources, against plain versions."""

import math
import random
import re
from hashlib import sha256
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sql_twin import same_as_sql  # isort: skip

from duelframe.llm import centroids, cube, merkle, registry


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_merkle_manifest"])
def test_same_as_sql(spark, sf, duck, name):
    same_as_sql(duck, registry.queries()[name](spark, sf), registry.oracle_sql()[name])


# --- operator 11


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [list(x) for _, x in first[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for j in range(len(cs)):
            mine = [x for (_, x), o in zip(kept, of, strict=True) if o == j]
            if mine:
                cs[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted(((i, near(x)[1], min(near(x)[0], 2**63 - 1)) for i, x in kept), key=repr), cs


def vector_rows(seed, dims, n=150, wide=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, wide) for _ in range(dims)]) for i in range(n)]
    rows += [(i, [float(rng.choice([-1, 0, 1])) for _ in range(dims)]) for i in range(n, n + 60)]  # ties
    rows += [rows[3], rows[3], rows[-1], (9001, None), (9002, [1.0] * (dims - 1)), (9003, [1.0] * (dims - 1) + [None]), (9004, [math.inf] + [0.0] * (dims - 1)), (9005, [math.nan] * dims), (None, [0.25] * dims), (9006, [0.0] * dims), (9007, [])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("dims,wide", [(64, 1.0), (6, 1.0), (7, 3e4), (5, 1e11)])
def test_clusters_as_by_hand(spark, dims, wide):
    rows = vector_rows(dims, dims, wide=wide)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS x", "3 AS norms").repartition(5)
    got, cs = centroids.cluster(df, k=9, rounds=3, dims=dims, segment=4)
    want, plain = plain_clusters(rows, 9, 3, dims)
    assert got.columns == ["vec_id", "cluster", "distance", "n_exact"]
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == want
    assert cs.tolist() == plain


def test_screening_leaves_few(spark, sf):
    found, _ = centroids.cluster(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert found.agg(F.avg("n_exact")).first()[0] < 2


def test_clusters_of_little(spark):
    none = spark.createDataFrame([], "vec_id string, embedding array<float>")
    got, cs = centroids.cluster(none)
    assert got.count() == 0 and len(cs) == 0
    few = spark.createDataFrame([("a", [1.0] * 64), ("b", [2.0] * 64), ("c", None)], "vec_id string, embedding array<float>")
    got, cs = centroids.cluster(few)
    assert len(cs) == 2 and {r.vec_id: r.distance for r in got.collect()} == {"a": 0, "b": 0}


# --- operator 12


def plain_tree(digests, path=None):
    """(root, [digests beside each leaf's path, as (left, right) pairs])."""
    sides = [[] for _ in digests]
    nodes, at = list(digests), list(range(len(digests)))
    while len(nodes) > 1:
        for leaf, n in enumerate(at):
            run = nodes[n // 3 * 3 : n // 3 * 3 + 3]
            sides[leaf].append(("".join(run[: n % 3]), "".join(run[n % 3 + 1 :])))
        nodes = [sha256("".join(nodes[i : i + 3]).encode()).hexdigest() for i in range(0, len(nodes), 3)]
        at = [n // 3 for n in at]
    return nodes[0], sides


def plain_manifest(rows):
    """[(id, source, leaf, subroot, root, proof)] of (id, source, leaf) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees.append(plain_tree([r[2] for r in groups[s]]))
    root, above = plain_tree([t[0] for t in trees])
    return sorted(((r[0], s, r[2], t[0], root, side + up) for s, t, up in zip(order, trees, above, strict=True) for r, side in zip(groups[s], t[1], strict=True)), key=repr)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_as_by_hand(spark, height):
    rng = random.Random(height)
    rows = [(rng.randrange(500) if rng.random() > 0.02 else None, rng.choice(["hot"] * 8 + [None, "", "é", "z", "hot "]), sha256(str(rng.randrange(200)).encode()).hexdigest()) for _ in range(300)]
    rows += [(1, f"s{i:02}", sha256(b"x").hexdigest()) for i in range(30)] + [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").selectExpr("*", "doc_id AS key", "source AS proof", "1 AS digest").repartition(6)
    got = merkle.manifest(df, keep=("key",), height=height)
    folded = got.withColumn("f", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.f == r.root and r.key == r.doc_id for r in folded)
    assert sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.proof]) for r in folded), key=repr) == plain_manifest(rows)


def test_manifest_of_little(spark, odd_docs, no_docs):
    leaf = merkle.record_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    assert merkle.manifest(no_docs.withColumn("leaf", leaf)).count() == 0
    got = merkle.manifest(odd_docs.withColumn("leaf", leaf)).collect()
    assert len(got) == odd_docs.count() and len({r.root for r in got}) == 1
    one = merkle.manifest(odd_docs.where("doc_id = 8").withColumn("leaf", leaf)).collect()
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof == []
    plain = {r.doc_id: r for r in odd_docs.collect()}[7]
    parts = [None if v is None else str(v) for v in (plain.doc_id, plain.source, plain.lang, plain.n_chars, plain.text)]
    text = "".join("-" if v is None else f"{len(v.encode())}:{v}" for v in parts)
    assert {r.doc_id: r.leaf for r in got}[7] == sha256(text.encode()).hexdigest()


# --- operator 13


def plain_targets(sizes, weights=(1, 2, 3), most=3.0):
    """{source: target} by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def mix_docs(spark, seed=5, n=1500):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * max(0, int(rng.lognormvariate(4, 1.2)))), rng.choice(["hot"] * 12 + ["b", "c", "é", "z", None])) for i in range(n)]
    rows += [(n + i, "x\ty\nz\x0b\x0c\r ü", "tiny") for i in range(3)] + [(n + 9, None, "void"), (n + 10, " \n", "void"), (None, "a b c", "b"), rows[0], rows[0]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS key", "3 AS p", "4 AS block", "5 AS taken")


def test_mix_meets_its_targets(spark):
    rows, df = mix_docs(spark)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(size)
    got = cube.mix(df).collect()
    assert sorted(((r.doc_id, r.size, r.source) for r in got), key=repr) == sorted(((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows), key=repr)
    for s in size:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and r.target == pytest.approx(want[s]) and r.taken == r.copies * r.size for r in mine)
        m = want[s] / size[s] if size[s] else 0
        assert all(math.floor(m + 1e-9) <= r.copies <= math.ceil(m - 1e-9) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 5, s
        assert abs(sum(r.copies for r in mine) - m * len(mine)) <= 6, s


def test_mix_is_the_same_again(spark):
    _, df = mix_docs(spark)
    once = sorted(map(repr, cube.mix(df).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        assert sorted(map(repr, cube.mix(df.repartition(11)).collect())) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(repr, cube.mix(df, seed=14).collect())) != once


def test_flight_keeps_the_totals_and_the_probabilities():
    sizes = np.array([900, 400, 350, 80, 75, 60, 60, 9, 8, 7, 0, 0])
    ends = np.zeros(len(sizes))
    for seed in range(3000):
        p = np.full(len(sizes), 0.3)
        q = cube.flight(p, sizes, Random(seed), 2)
        assert abs((q * sizes).sum() - (p * sizes).sum()) < 1e-6 and abs(q.sum() - p.sum()) < 1e-9
        assert ((q > 0) & (q < 1)).sum() <= 2
        ends += q
    assert np.abs(ends / 3000 - 0.3).max() < 0.04


def test_mix_of_odd_and_no_documents(spark, odd_docs, no_docs):
    assert cube.mix(no_docs).count() == 0
    got = cube.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.taken <= 3 * r.size for r in got)
