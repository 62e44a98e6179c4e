"""Near-duplicate embeddings by navigable small-world graphs (operator 9).

Vectors are compared only within a label. Equal vectors become one with a weight. A label's vectors are dealt into
shards of bounded size; each shard gets a hierarchical navigable small-world graph, and every shard is queried with every
vector of the label, shard pair by shard pair. Searches run many queries in step: they descend the layers and
widen to a beam at the base layer. Each search is audited: a sample of the queries against brute force, and probes, which
are vectors of the shard turned away to a cosine of exactly the threshold and have to find where they came from; the beam doubles
until both reach the recall asked for. What is found links clusters of near vectors; all pairs of linked clusters are verified
in double precision.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, forest, mix64, numbered, read, scratch

_NONE = np.float32(-np.inf)


class Graph:
    """Unit vectors and their neighbours by layer; -1 where there is none."""

    def __init__(self, x: np.ndarray, seed: np.ndarray, m: int = 12, beam: int = 40, block: int = 512):
        n = len(x)
        self.x, self.m, self.beam = x.astype(np.float32), m, beam
        h = mix64(seed.astype(np.int64).view(np.uint64))
        u = ((h >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
        self.level = np.minimum((-np.log(u) / np.log(m)).astype(np.int64), 12)
        top = int(self.level.max()) if n else 0
        self.near = [np.full((n, 3 * self._most(k) // 2), -1, np.int32) for k in range(top + 1)]
        self.count = [np.zeros(n, np.int64) for _ in range(top + 1)]
        self.entry, order, done = -1, np.argsort(h, kind="stable"), 0
        while done < n:  # each block searches the graph so far and itself
            size = min(block, max(1, done))
            self._insert(order[done : done + size])
            done += size

    def _most(self, layer: int) -> int:
        return self.m if layer else 2 * self.m

    def _sims(self, nodes: np.ndarray, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.x[nodes], q[rows])

    def search(self, q: np.ndarray, starts: np.ndarray, layer: int, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities), best first, that a beam search for each of the unit vectors q finds from its starts."""
        rows_, n, near = len(q), len(self.x), self.near[layer]
        width = min(width, beam)
        seen = np.zeros((rows_, n), bool)
        ids = np.full((rows_, beam), -1, np.int64)
        sims, todo = np.full((rows_, beam), _NONE), np.zeros((rows_, beam), bool)

        def merge(r: np.ndarray, v: np.ndarray) -> None:
            seen[r, v] = True
            s = self._sims(v, q, r)
            good = s > sims[r].min(axis=1) if beam < 8 else s > low[r]
            r, v, s = r[good], v[good], s[good]
            if not len(r):
                return
            u, begin, k = np.unique(r, return_index=True, return_counts=True)
            at = np.arange(len(r)) - np.repeat(begin, k)
            row = np.repeat(np.arange(len(u)), k)
            more = np.full((len(u), int(k.max())), -1, np.int64)
            more_s = np.full(more.shape, _NONE)
            more[row, at], more_s[row, at] = v, s
            all_s = np.concatenate([sims[u], more_s], axis=1)
            pick = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[u] = np.take_along_axis(all_s, pick, 1)
            ids[u] = np.take_along_axis(np.concatenate([ids[u], more], axis=1), pick, 1)
            todo[u] = np.take_along_axis(np.concatenate([todo[u], more >= 0], axis=1), pick, 1)
            low[u] = sims[u].min(axis=1)

        low = np.full(rows_, _NONE)
        r, c = np.nonzero(starts >= 0)
        merge(r, starts[r, c])
        live = np.arange(rows_)
        while len(live):
            open_ = np.where(todo[live], sims[live], _NONE)
            pick = np.argpartition(-open_, width - 1, axis=1)[:, :width]
            go = np.take_along_axis(open_, pick, 1) > _NONE
            ok = go.any(axis=1)
            live, pick, go = live[ok], pick[ok], go[ok]
            if not len(live):
                break
            todo[live[:, None], pick] = False
            nb = near[ids[live[:, None], pick]]
            r, w, c = np.nonzero((nb >= 0) & go[:, :, None])
            v, r = nb[r, w, c].astype(np.int64), live[r]
            fresh = ~seen[r, v]
            key = np.unique(r[fresh] * n + v[fresh])
            merge(key // n, key % n)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _select(self, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row up to `most` nodes: first those nearer to the row's own node than to any chosen one, then the next best."""
        out = np.full((len(nodes), most), -1, np.int32)
        step = max(1, (8 << 20) // nodes.shape[1] ** 2)
        for at in range(0, len(nodes), step):
            order = np.argsort(-sims[at : at + step], axis=1, kind="stable")
            s = np.take_along_axis(sims[at : at + step], order, 1)
            v = np.take_along_axis(nodes[at : at + step], order, 1)
            x = self.x[v]
            among = x @ x.transpose(0, 2, 1)
            closest = np.full(s.shape, np.float32(-2))
            chosen = np.zeros(s.shape, bool)
            for k in range(s.shape[1]):
                ok = (closest[:, k] < s[:, k]) & (v[:, k] >= 0)
                chosen[:, k] = ok
                np.maximum(closest, among[:, k], out=closest, where=ok[:, None])
            first = np.argsort(np.where(v < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
            got = np.take_along_axis(v, first, 1)
            out[at : at + step, : got.shape[1]] = got
        return out

    def _insert(self, new: np.ndarray) -> None:
        q, top = self.x[new], int(self.level[new].max())
        before = int(self.level[self.entry]) if self.entry >= 0 else -1
        starts = np.full((len(new), 1), self.entry, np.int64)
        for layer in range(max(top, before), -1, -1):
            on = np.flatnonzero(self.level[new] >= layer)
            if layer <= before:
                below = np.flatnonzero(self.level[new] < layer)
                found, sims = np.full((len(new), self.beam), -1, np.int64), np.full((len(new), self.beam), _NONE)
                for rows, beam in ((on, self.beam), (below, 4)):
                    if len(rows):
                        found[rows, :beam], sims[rows, :beam] = self.search(q[rows], starts[rows], layer, beam)
                starts = found[:, :8] if layer else found
            if not len(on):
                continue
            own = q[on] @ q[on].T
            np.fill_diagonal(own, _NONE)
            k = min(len(on), self.beam)
            among = np.argpartition(-own, k - 1, axis=1)[:, :k]
            nodes, s = np.where(np.take_along_axis(own, among, 1) > _NONE, new[on][among], -1), np.take_along_axis(own, among, 1)
            if layer <= before:
                nodes, s = np.concatenate([found[on], nodes], axis=1), np.concatenate([sims[on], s], axis=1)
            chosen = self._select(nodes, s, self.m)
            near, count = self.near[layer], self.count[layer]
            near[new[on], : self.m] = chosen
            count[new[on]] = (chosen >= 0).sum(axis=1)
            r, c = np.nonzero(chosen >= 0)
            self._back(layer, chosen[r, c].astype(np.int64), new[on][r])
        if top > before:
            self.entry = int(new[self.level[new].argmax()])

    def _back(self, layer: int, j: np.ndarray, i: np.ndarray) -> None:
        """Adds the links from j to i; rows that run over keep the best."""
        if not len(j):
            return
        near, count, width = self.near[layer], self.count[layer], self.near[layer].shape[1]
        s = self._sims(i, self.x, j)
        order = np.lexsort((-s, j))
        j, i = j[order], i[order]
        u, begin, k = np.unique(j, return_index=True, return_counts=True)
        rank = np.arange(len(j)) - np.repeat(begin, k)
        full = np.repeat(count[u] + k > width, k)
        easy = ~full
        near[j[easy], count[j[easy]] + rank[easy]] = i[easy]
        over = u[count[u] + k > width]
        np.add.at(count, j[easy], 1)
        if len(over):
            ok = full & (rank < width)
            extra = np.full((len(over), width), -1, np.int64)
            extra[np.searchsorted(over, j[ok]), rank[ok]] = i[ok]
            nodes = np.concatenate([near[over].astype(np.int64), extra], axis=1)
            sims = np.einsum("ijk,ik->ij", self.x[nodes], self.x[over])
            sims[nodes < 0] = _NONE
            kept = self._select(nodes, sims, self._most(layer))
            near[over] = -1
            near[over, : kept.shape[1]] = kept
            count[over] = (kept >= 0).sum(axis=1)

    def nearest(self, q: np.ndarray, beam: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of a beam search at the base layer, block by block."""
        out = []
        for at in range(0, len(q), block):
            part = q[at : at + block].astype(np.float32)
            starts = np.full((len(part), 1), self.entry, np.int64)
            for layer in range(int(self.level[self.entry]), 0, -1):
                starts = self.search(part, starts, layer, 4)[0]
            out.append(self.search(part, starts, 0, beam))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Shard:
    """Ids, vectors and weights (how many ids have the vector), their graph, and the cluster of each vector."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, weight: np.ndarray):
        self.ids, self.raw, self.weight = ids, raw, weight
        self.graph = Graph(self.unit(), ids)
        self.cluster = np.arange(len(ids))
        self.start = 16  # the beam with which an audit begins

    def unit(self) -> np.ndarray:
        return self.raw / np.sqrt((self.raw * self.raw).sum(axis=1))[:, None]


def probes(unit: np.ndarray, threshold: float, sample: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors at a cosine of `threshold` from some of the rows of unit, those rows)."""
    rows = np.unique(np.linspace(0, len(unit) - 1, min(sample, len(unit))).astype(int))
    if unit.shape[1] < 2:
        return unit[rows], rows
    side = np.random.Generator(np.random.PCG64(len(unit))).standard_normal((len(rows), unit.shape[1]))
    side -= (side * unit[rows]).sum(axis=1)[:, None] * unit[rows]
    side /= np.maximum(np.sqrt((side * side).sum(axis=1)), 1e-300)[:, None]
    return threshold * unit[rows] + np.sqrt(max(0.0, 1 - threshold**2)) * side, rows


def candidates(shard: Shard, other: Shard, threshold: float, recall: float = 0.99, slack: float = 0.02, sample: int = 512) -> tuple[np.ndarray, int, int]:
    """(pairs of clusters, of shard and of other; links and probes asked for in the audit; those found).

    Clusters are paired if a search from a row of one finds a row of the other at a cosine of threshold - slack or more. Within
    one shard they are formed by what the searches find. A beam that would touch as many vectors as there are is exhaustive.
    """
    graph, x, same, n = shard.graph, other.unit().astype(np.float32), shard is other, len(shard.ids)
    least, beam = np.float32(threshold - slack), shard.start
    turned, origin = probes(shard.unit(), threshold)
    turned = turned.astype(np.float32)
    goal = np.einsum("ij,ij->i", graph.x[origin], turned) - 1e-5
    pick = np.unique(np.linspace(0, len(x) - 1, min(sample, len(x))).astype(int))
    q, v = np.nonzero(x[pick] @ graph.x.T >= np.float32(threshold))
    q = pick[q]
    if same:
        q, v = q[q != v], v[q != v]

    def paired(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        if same:
            shard.cluster = np.arange(n)
            star = forest(np.stack([rows, nodes], axis=1)[rows != nodes])
            shard.cluster[star[:, 1]] = star[:, 0]
        return np.unique(shard.cluster[nodes].astype(np.int64) * len(x) + other.cluster[rows])

    while beam * 2 * graph.m < n:
        met = int((graph.nearest(turned, beam)[1][:, 0] >= goal).sum())
        if met >= recall * len(origin):
            found, s = graph.nearest(x, beam)
            r, c = np.nonzero(s >= least)
            pairs = paired(r, found[r, c])
            got = int(np.isin(shard.cluster[v].astype(np.int64) * len(x) + other.cluster[q], pairs).sum())
            if got >= recall * len(v):
                shard.start = beam
                break
        beam *= 2
    else:
        parts = [(r + at, c) for at in range(0, len(x), 1024) for r, c in [np.nonzero(x[at : at + 1024] @ graph.x.T >= least)]]
        pairs = paired(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        met, got = len(origin), len(v)
    return np.stack([pairs // len(x), pairs % len(x)], axis=1), len(v) + len(origin), got + met


def _groups(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows by label, where each label's rows begin, with an end)."""
    order = np.argsort(label, kind="stable")
    return order, np.searchsorted(label[order], np.arange(int(label.max()) + 2 if len(label) else 1))


def verify(a: Shard, b: Shard, pairs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighted links of a's rows, of b's rows, links as star edges of ids) over all pairs of rows of the cluster pairs, in double precision.

    a and b may be one shard; then pairs are (cluster, cluster), and a vector's own copies are not counted.
    """
    same = a is b
    ua, ub = a.unit(), b.unit()
    da, db = np.zeros(len(ua), np.int64), np.zeros(len(ub), np.int64)
    (oa, sa), (ob, sb) = _groups(a.cluster), _groups(b.cluster)
    edges = np.zeros((0, 2), np.int64)
    for ca, cb in pairs.tolist():
        left, right = oa[sa[ca] : sa[ca + 1]], ob[sb[cb] : sb[cb + 1]]
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            cos = ua[rows] @ ub[right].T
            hit = cos >= threshold
            for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-9), strict=True):
                hit[i, j] = _cosines(a.raw[rows[i]][None], b.raw[right[j]][None])[0] >= threshold
            if same:
                hit &= rows[:, None] != right[None, :]
            da[rows] += hit @ b.weight[right]
            if not same:
                db[right] += a.weight[rows] @ hit
            # each row's first link, and what joins different ones of these: the rest adds nothing to the components
            first = np.where(hit.any(axis=1), right[hit.argmax(axis=1)], -1)
            ok = first >= 0
            mine = [np.stack([a.ids[rows[ok]], b.ids[first[ok]]], axis=1)]
            lead = np.where(hit, first[:, None], np.iinfo(np.int64).max).min(axis=0)  # of each column, the least of its rows' firsts
            other = hit & (first[:, None] != lead[None, :])
            i, j = np.nonzero(other)
            if len(i):
                u = np.unique(first[i] * len(ub) + lead[j])
                mine.append(np.stack([b.ids[u // len(ub)], b.ids[u % len(ub)]], axis=1))
            j = np.flatnonzero(hit.any(axis=0))
            mine.append(np.stack([b.ids[lead[j]], b.ids[right[j]]], axis=1))
            edges = forest(np.concatenate([edges, *mine]))
    return da, db, edges


def within_shard(shard: Shard, threshold: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(weighted links by row, star edges, links and probes asked for and found); sets the shard's clusters."""
    pairs, asked, got = candidates(shard, shard, threshold)
    links, _, edges = verify(shard, shard, pairs[np.bincount(shard.cluster)[pairs[:, 0]] > 1], threshold)
    return links, edges, asked, got


def between_shards(a: Shard, b: Shard, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(weighted links of a's rows, of b's rows, star edges, links and probes asked for and found)."""
    one, asked, got = candidates(a, b, threshold)
    two, asked2, got2 = candidates(b, a, threshold)
    return *verify(a, b, np.unique(np.concatenate([one, two[:, ::-1]]), axis=0), threshold), asked + asked2, got + got2


def _found(ids: np.ndarray, links: np.ndarray, edges: np.ndarray, asked: int, got: int) -> dict:
    some = links > 0
    return {"id": ids[some], "n": links[some], "root": edges[:, 0], "member": edges[:, 1], "asked": asked, "got": got}


_FOUND = "id array<long>, n array<long>, root array<long>, member array<long>, asked long, got long"


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, shard_rows: int = 8192, shard_bytes: int = 64 << 20, audit: list | None = None
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Two vectors of one label (not null) and one length are linked if their cosine is at least threshold.
    Null or zero vectors, and those with null or non-finite components, link with nothing, nor do rows with
    a null id or label; such a row is its own component (null for a null id, and then not kept). Repeated rows of an id are
    one vector (the least of them), and each of them gets its result. An empty table gives an empty result. Ids may have any type that has an order.
    A shard has at most shard_rows vectors and about shard_bytes. audit: gets (links and probes asked for, found) over all searches' audits.
    """
    vectors, back = numbered(vectors.select(id_col, vector_col, label_col), id_col)
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    ok = F.col("_row").isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & (norm > 0)
    rows = vectors.where(F.coalesce(ok, F.lit(False)))
    rows = rows.select(F.col("_row").alias("id"), F.col(label_col).cast("string").alias("label"), v.cast("array<double>").alias("v"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")
    key = ["label", "h1", "h2"]  # of a vector: two 64-bit hashes
    members = scratch(rows.withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64("v")}), "vectors")
    classes = scratch(members.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "vector-classes")
    firsts = members.join(classes.select("rep", "weight"), F.col("id") == F.col("rep")).select("label", "v", "rep", "weight", F.size("v").alias("dim"))
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(shard_bytes) / (8 * F.col("dim")))))
    sizes = firsts.groupBy("label", "dim").agg(F.count("*").alias("m")).select("label", "dim", F.ceil(F.col("m") / most).cast("int").alias("shards"))
    dealt = firsts.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        shard = Shard(pdf["rep"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["weight"].to_numpy(np.int64))
        found = _found(shard.ids, *within_shard(shard, threshold))
        data = zlib.compress(pickle.dumps(shard, 5), 1) if pdf["shards"].iloc[0] > 1 else None
        return pd.DataFrame([{"label": key[0], "dim": key[1], "shard": key[2], "shards": int(pdf["shards"].iloc[0]), "data": data, **found}])

    index = dealt.groupBy("label", "dim", "shard").applyInPandas(build, f"label string, dim int, shard int, shards int, data binary, {_FOUND}")
    index = scratch(index, "graphs")
    found = index.select("id", "n", "root", "member", "asked", "got")
    units = int(index.agg(F.sum(F.col("shards") - 1 - F.col("shard"))).first()[0] or 0)
    if units:
        left = index.where("shard < shards - 1").select("label", "dim", "data", F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1)).alias("other"))
        right = index.select("label", "dim", F.col("shard").alias("other"), F.col("data").alias("data2"))
        pairs = left.join(right, ["label", "dim", "other"]).select("data", "data2").repartition(min(units, 4096))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = [pa.list_(pa.int64())] * 4 + [pa.int64()] * 2
            for b in batches:
                for r in range(b.num_rows):
                    one, two = (pickle.loads(zlib.decompress(c[r].as_py())) for c in b.columns)
                    na, nb, edges, asked, got = between_shards(one, two, threshold)
                    out = _found(np.concatenate([one.ids, two.ids]), np.concatenate([na, nb]), edges, asked, got)
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out.values(), kinds, strict=True)], names=list(out))

        found = found.union(scratch(pairs.mapInArrow(compare, _FOUND), "vector-links"))
    if audit is not None:
        audit[:] = found.agg(F.sum("asked"), F.sum("got")).first() or ()
    degree = found.select(F.explode(F.arrays_zip("id", "n")).alias("x")).groupBy(F.col("x.id").alias("rep")).agg(F.sum("x.n").alias("n"))
    edges = found.select(F.explode(F.arrays_zip("root", "member")).alias("x")).select("x.root", "x.member")
    parts = connected_components(edges, "root", "member")
    reps = classes.join(degree, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select(*key, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component")).where("n > 0")
    joined = members.select("id", *key).join(scratch(reps, "vector-results"), key).select("id", "n", "component")
    out = vectors.select(F.col(id_col).alias("_given"), F.col("_row").alias("_v")).join(joined, F.col("_v") == F.col("id"), "left")
    component = F.coalesce("component", "_v")
    out = out.select(F.col("_given").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("_v"), F.lit(False)).alias("kept"))
    return back(out, "component_id")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE ok AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, least(v.vec_id, coalesce(m.g, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(m.g, v.vec_id)) AS kept
FROM embeddings v
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) d ON d.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS g FROM reach GROUP BY a) m ON m.a = v.vec_id
"""
