"""Jaccard join on word shingles with Bayesian candidate pruning (operator 8).

Texts with the same shingle set are one class; only class representatives (smallest id) are compared.
MinHash values (16 bits each, 128 of them) put representatives into 32 buckets of four values; a pair with
similarity 0.8 misses all of them with a probability below 1e-7. Pairs of a bucket are compared some
values at a time and dropped when the posterior probability (uniform prior) of reaching the threshold is
below the tolerance. What survives is verified exactly on the shingle sets, which travel once to each block
of their group. Buckets and groups of any size are split into blocks, and the pairs inside are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, connected_components, forest, mix64, numbered, read, scratch, unused

HASHES, ROWS, STEP = 128, 4, 16
_rng = np.random.Generator(np.random.PCG64(20_08))
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


class Shingler:
    """Sorted 64-bit hashes of a text's different shingles: five words each, or all words of a shorter text."""

    def __init__(self, k: int):
        self.k, self.words = k, WordHash()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode("utf-8", "replace").split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self.words(words)
        k = min(self.k, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(mix64(out))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest of each hash function's values."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        v = np.multiply.outer(_A, x[at : at + 2048])
        v += _B[:, None]
        np.minimum(low, v.min(axis=1), out=low)
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x2C1B3C6D)
    return (low >> np.uint32(16)).astype(np.uint16)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After STEP, 2 STEP, ... compared values: the fewest equal ones with P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail is that of a binomial.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(s: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, least: list[int]) -> np.ndarray:
    """Mask of the pairs (rows a, b of the values s) that first meet in this band and outlast the pruning."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for step, m in enumerate(least):
        cols = slice(step * STEP, (step + 1) * STEP)
        same = s[a[alive], cols] == s[b[alive], cols]
        meets = same.reshape(len(alive), STEP // ROWS, ROWS).all(axis=2)
        first = step * (STEP // ROWS) + np.arange(STEP // ROWS)
        earlier = (meets & (first[None, :] < band[alive][:, None])).any(axis=1)
        matches[alive] += same.sum(axis=1)
        alive = alive[(matches[alive] >= m) & ~earlier]
    mask = np.zeros(len(a), bool)
    mask[alive] = True
    return mask


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of whole units, one unit or several at a time; rows come sorted by the first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            n = part.num_rows
            cols = [part.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
            new = np.zeros(n, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            if held:
                last = held[-1]
                new[0] = any(last.column(i)[last.num_rows - 1].as_py() != part.column(i)[0].as_py() for i in range(keys))
            starts = np.flatnonzero(new)
            if len(starts) == 0:
                held.append(part)
                continue
            cut = int(starts[-1])
            if cut:
                held.append(part.slice(0, cut))
            if held:
                yield pa.Table.from_batches(held)
            held = [part.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for i in range(keys):
        c = table.column(i).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _pairs(starts: np.ndarray, side: np.ndarray, cross: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within units: all of them, or for units of two blocks those across; about `most` at a time."""
    a_all, b_all, held = [], [], 0
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        rows = np.arange(s, e)
        if cross[s]:
            left, right = rows[side[s:e] == 0], rows[side[s:e] == 1]
        else:
            left = right = rows
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            a, b = np.repeat(part, len(right)), np.tile(right, len(part))
            if not cross[s]:
                a, b = a[a < b], b[a < b]
            if len(a):
                a_all.append(a)
                b_all.append(b)
                held += len(a)
            if held >= most:
                yield np.concatenate(a_all), np.concatenate(b_all)
                a_all, b_all, held = [], [], 0
    if held:
        yield np.concatenate(a_all), np.concatenate(b_all)


def _blocks(df: DataFrame, size: str, block: int, node: str) -> DataFrame:
    """Adds (i, j, side) for the blocks a row must go to; a unit of one block is (0, 0, 0)."""
    k = F.ceil(F.col(size) / F.lit(block)).cast("int")
    df = df.withColumn("_k", k).withColumn("_own", F.when(F.col("_k") > 1, F.pmod(F.xxhash64(node), F.col("_k"))).otherwise(0).cast("int"))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    own, o = F.col("_own"), F.col("_o")
    return df.withColumns({"i": F.least(own, o), "j": F.greatest(own, o), "side": (own > o).cast("int")}).drop("_k", "_own", "_o")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 512, verify_block: int = 512) -> DataFrame:
    """(id, class_id, n_links, group_id) for every row.

    class_id: the smallest id whose text has the same shingle set; n_links: the other classes whose shingle
    sets have a Jaccard similarity of at least threshold with this one; group_id: the smallest id reachable
    by links. Texts without a word link with nothing, and each is its own class. Texts under k words have
    one shingle. Rows with a null id have null class and group and no links. Repeated rows get the same
    result; different texts of one id are linked each for itself. Ids may have any type that has an order.
    """
    rows, back = numbered(docs.select(id_col, text_col), id_col, text_col)
    out = _row_links(rows, text_col, k, threshold, tolerance, block, verify_block)
    out = out.select(F.col("id").alias(id_col), F.col("rep").alias("class_id"), "n_links", F.col("component").alias("group_id"))
    return back(out, id_col, "class_id", "group_id")


def _row_links(rows: DataFrame, text_col: str = "text", k: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 512, verify_block: int = 512) -> DataFrame:
    """(id, rep, n_links, component) for rows with a number _row."""
    least, bands = least_matches(threshold, tolerance), HASHES // ROWS
    base = rows.select(F.col("_row").alias("id"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(k)
        for b in batches:
            cls, sig = [], []
            for text in b.column(1).to_pylist():
                s = shingler(text)
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["id", "cls", "sig"])

    signed = scratch(base.mapInArrow(sign, "id long, cls binary, sig binary"), "signed")
    classes = signed.where("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("rep"))
    member = signed.select("id", "cls").join(classes, "cls", "left")
    first = classes.select("cls", F.col("rep").alias("_rep"))
    reps = scratch(signed.join(first, "cls").where("id = _rep").select("id", "sig").dropDuplicates(["id"]), "reps")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), bands))], names=["band", "key", "id"]
                )

    keys = reps.mapInArrow(spread, "band int, key long, id long")
    sizes = keys.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    sizes = scratch(sizes, "bucket-sizes")  # so that adaptive execution can split the join's hot keys
    active = _blocks(keys.join(sizes, ["band", "key"]), "m", block, "id").join(reps, "id").select("band", "key", "i", "j", "side", "id", "sig")
    unit = ["band", "key", "i", "j"]
    active = active.repartition(*unit).sortWithinPartitions(*unit)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(batches, 4):
            starts = _starts(t, 4)
            s = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            ids, side, band = t.column("id").to_numpy(), t.column("side").to_numpy(), t.column("band").to_numpy()
            cross = t.column("i").to_numpy() != t.column("j").to_numpy()
            for a, b in _pairs(starts, side, cross):
                mask = surviving(s, a, b, band[a], least)
                if mask.any():
                    yield _adjacency(np.stack([ids[a[mask]], ids[b[mask]]], axis=1))

    candidates = scratch(active.mapInArrow(prune, "a long, bs array<long>, root long"), "candidates")
    groups = scratch(connected_components(candidates.select("a", "root"), "a", "root"), "groups")
    sized = scratch(groups.join(groups.groupBy("component").agg(F.count("*").alias("m")), "component"), "sized")

    texts = _blocks(base.join(sized, base["id"] == sized["node"]).drop("node"), "m", verify_block, "id")
    order = ["component", "i", "j"]

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                data = pa.array([shingler(t).tobytes() for t in part.column(4).to_pylist()], pa.binary())
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(np.zeros(n, np.int32)), data], names=[*order, "id", "kind", "data"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            comp, blk, ids, bs, bb = (b.column(i).to_pylist() for i in range(5))
            for c, own, a, other, where in zip(comp, blk, ids, bs, bb, strict=True):
                other, where = np.array(other, np.int64), np.array(where, np.int64)
                for o in np.unique(where).tolist():
                    for x, v in zip(out, (c, min(own, o), max(own, o), a, other[where == o].tobytes()), strict=True):
                        x.append(v)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(np.ones(n, np.int32)), pa.array(out[4], pa.binary())], names=[*order, "id", "kind", "data"]
            )

    schema = "component long, i int, j int, id long, kind int, data binary"
    sets = texts.select(*order, "id", "text").mapInArrow(shingled, schema).dropDuplicates([*order, "id"])
    n = F.ceil(F.col("m") / F.lit(verify_block)).cast("int")

    def own(x):
        return F.when(F.col("_k") > 1, F.pmod(F.xxhash64(x), F.col("_k"))).otherwise(0).cast("int")

    lists = candidates.where(F.size("bs") > 0).join(sized, F.col("a") == F.col("node")).withColumn("_k", n)
    lists = lists.select("component", own(F.col("a")).alias("own"), "a", "bs", F.transform("bs", own).alias("bb")).mapInArrow(routed, schema)
    both = sets.union(lists).repartition(*order).sortWithinPartitions(*order, "kind")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(batches, 3):
            kinds, ids, data = t.column("kind").to_numpy(), t.column("id").to_numpy(), t.column("data")
            starts = _starts(t, 3)
            linked: list[np.ndarray] = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = {int(ids[r]): np.frombuffer(data[r].as_py(), np.uint64) for r in range(s, e) if kinds[r] == 0}
                for r in range(s, e):
                    if kinds[r] == 1:
                        a = int(ids[r])
                        x = own[a]
                        hits = []
                        for b in np.unique(np.frombuffer(data[r].as_py(), np.int64)).tolist():
                            y = own[b]
                            small, large = (x, y) if len(x) <= len(y) else (y, x)
                            if len(small) < threshold * len(large) - 1:
                                continue
                            at = np.searchsorted(large, small)
                            common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                            if common >= threshold * (len(x) + len(y) - common) - 1e-9:
                                hits.append((a, b))
                        if hits:
                            linked.append(np.array(hits, np.int64))
            if linked:
                pairs = np.concatenate(linked)
                nodes, number = np.unique(pairs, return_counts=True)
                root = dict(zip(nodes.tolist(), nodes.tolist(), strict=True)) | {m: r for r, m in forest(pairs).tolist()}
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(number.astype(np.int64)), pa.array([root[x] for x in nodes.tolist()], pa.int64())], names=["id", "n", "root"])

    links = scratch(both.mapInArrow(verify, "id long, n long, root long"), "links")
    joined = connected_components(links.select("id", "root"), "id", "root").select(F.col("node").alias("rep"), "component")
    degree = links.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    out = member.join(degree.join(joined, "rep"), "rep", "left")
    return out.select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep", "id").alias("component"))


def _adjacency(pairs: np.ndarray) -> pa.RecordBatch:
    """One row for each node: its larger partners, and the root of its tree."""
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    nodes = np.unique(pairs)
    root = nodes.copy()
    f = forest(pairs)
    root[np.searchsorted(nodes, f[:, 1])] = f[:, 0]
    first = np.searchsorted(pairs[:, 0], np.append(nodes, np.iinfo(np.int64).max)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(pa.array(first), pa.array(pairs[:, 1])), pa.array(root)], names=["a", "bs", "root"])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row (by id, for different texts of one id by a hash) of each group, with its repetitions; rows with a null id stay."""
    number = unused(docs, "_row")
    rows, _ = numbered(docs, id_col, text_col, number)
    found = _row_links(rows.select(F.col(number).alias("_row"), F.col(text_col).alias("_text")), "_text")
    keep = found.where("id = component").select(F.col("id").alias("_kept")).distinct()
    kept = rows.where(F.col(number).isNotNull()).join(keep, F.col(number) == F.col("_kept"), "left_semi")
    return kept.union(rows.where(F.col(number).isNull())).drop(number)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\t\n\x0b\f\r ]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS s FROM w
), cls AS (
  SELECT doc_id, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id FROM sh
), reps AS MATERIALIZED (SELECT doc_id AS c, s, len(s) AS n FROM cls WHERE doc_id = class_id AND len(s) > 0),
tok AS MATERIALIZED (SELECT c, n, unnest(s) AS g FROM reps),
links AS MATERIALIZED (
  SELECT x.c AS a, y.c AS b FROM tok x JOIN tok y ON x.g = y.g AND x.c <> y.c
  GROUP BY x.c, y.c, x.n, y.n HAVING count(*) * 10 >= 8 * (x.n + y.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT k.doc_id, k.class_id, coalesce(d.n, 0) AS n_links, least(k.class_id, coalesce(m.g, k.class_id)) AS group_id
FROM cls k
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) d ON d.a = k.class_id
LEFT JOIN (SELECT a, min(b) AS g FROM reach GROUP BY a) m ON m.a = k.class_id
"""
