"""Clustering of integer vectors around centroids, screened by compressed vectors and norms of segments (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch, unused

LARGEST = 2**63 - 1
_ROWS = 500  # of a batch that are compared at a time


def segment_norms(x: np.ndarray, segment: int) -> np.ndarray:
    """The Euclidean norms of a matrix's rows by segments of `segment` components, the last one shorter if need be."""
    starts = np.arange(0, x.shape[1], segment)
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1))


def compress(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signed bytes q, shifts s, remainders e) of rows of whole numbers: x = q * 2 ** s + e, with the least s for which q fits a byte."""
    bits = np.frexp(np.abs(x).max(axis=1, initial=0).astype(np.float64))[1]
    s = np.maximum(0, bits - 7).astype(np.int64)
    q = x >> s[:, None]
    return q.astype(np.int8), s, x - (q << s[:, None])


class Screen:
    """Nearest centroids: exact integer distances only for those that a lower bound from compressed vectors cannot rule out.

    x = q 2^s + e, and so for a centroid c: its product with x is that of the two q's, which single precision holds exactly, and two
    products with a remainder, which by Cauchy and Schwarz are at most the sums over segments of products of norms. The norms of the
    vectors' segments are stored. The centroid of the least bound is measured first; those whose bound, less a
    slack for rounding, is not above that distance are measured too.
    """

    def __init__(self, centroids: np.ndarray, segment: int):
        self.centroids = centroids
        q, s, e = compress(centroids)
        self.small, self.scale = q.astype(np.float32), 2.0**s
        self.norms = np.concatenate([segment_norms(e, segment), segment_norms(centroids, segment)], axis=1)
        self.squares = (centroids.astype(np.float64) ** 2).sum(1)
        self.widest = int(np.abs(centroids).max(initial=0))

    def __call__(self, x: np.ndarray, small: np.ndarray, shift: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the nearest centroid, the smaller one of equals; squared distance; how many centroids were measured)."""
        c, wide = self.centroids, (int(np.abs(x).max(initial=0)) + self.widest) ** 2 * max(1, x.shape[1])
        if wide > LARGEST:  # beyond a long: exact all the same
            x, c = x.astype(object), c.astype(object)
        rows = np.arange(len(x))
        both = (x.astype(np.float64) ** 2).sum(1)[:, None] + self.squares[None, :]
        product = (small.astype(np.float32) @ self.small.T) * (2.0**shift)[:, None] * self.scale[None, :]
        bound = both * (1 - 1e-9) - 2 * (product + norms @ self.norms.T) - 1e-3
        first = bound.argmin(1)
        out = np.full(bound.shape, LARGEST if x.dtype != object else wide + 1, x.dtype)
        out[rows, first] = ((x - c[first]) ** 2).sum(1)
        left = bound <= out[rows, first].astype(np.float64)[:, None]
        left[rows, first] = False
        i, k = np.nonzero(left)
        out[i, k] = ((x[i] - c[k]) ** 2).sum(1)
        best = out.argmin(1)
        return best, out[rows, best], left.sum(1) + 1


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: float, segment: int) -> DataFrame:
    """(_of, x, small, shift, norms): floor(scale * component) of the vectors that can be used, compressed, and norms of segments; written once."""
    own = vectors.select(F.col(id_col).alias("_of"), F.col(vec_col).cast("array<double>").alias("_v")).where(F.size("_v") == dims)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten()
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(np.where(v.is_null().to_numpy(zero_copy_only=False), np.nan, v.to_numpy(zero_copy_only=False)).reshape(-1, dims) * scale)
            ok = (np.abs(x) <= 2.0**53).all(axis=1)  # false for what is not a number, too
            x = x[ok].astype(np.int64)
            q, s, e = compress(x)
            n = np.concatenate([segment_norms(q, segment) * (2.0**s)[:, None], segment_norms(e, segment)], axis=1)
            wide, norms = (pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())) for m in (x, n))
            small = pa.array([r.tobytes() for r in q], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), wide, small, pa.array(s, pa.int32()), norms], names=["_of", "x", "small", "shift", "norms"])

    return scratch(own.mapInArrow(prepare, f"_of {own.schema['_of'].dataType.simpleString()}, x array<long>, small binary, shift int, norms array<double>"), "vectors")


def _blocks(batches: Iterator[pa.RecordBatch], screen: Screen, dims: int) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            part = b.slice(at, _ROWS)
            x = _matrix(part.column("x"), dims)
            small = np.frombuffer(b"".join(part.column("small").to_pylist()), np.int8).reshape(-1, dims)
            yield part, x, *screen(x, small, part.column("shift").to_numpy(), _matrix(part.column("norms"), screen.norms.shape[1]))


def _sums(screen: Screen, dims: int) -> Callable:
    """A task's sums and counts by centroid, as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(screen.centroids)
        total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for _, x, best, _, _ in _blocks(batches, screen, dims):
            for c in np.unique(best):
                mine = x[best == c]
                total[c] += mine.sum(0).astype(object)  # at most 500 numbers of 54 bits
                count[c] += len(mine)
        used = np.flatnonzero(count)
        if len(used):
            sums = [[str(t) for t in total[c]] for c in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums, pa.list_(pa.string())), pa.array(count[used])], names=["cluster", "sums", "n"])

    return run


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, salt: str = "2", segment: int = 8
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, n_exact) of each usable vector, the final centroids as whole numbers).

    Usable are vectors of exactly `dims` components, none null or non-finite; each component x counts as floor(scale * x). The centroids
    start as the k vectors whose SHA-256 of "salt:id" is smallest; each round assigns all vectors to the nearest centroid
    (equal distances: the smaller number) and moves every centroid that has vectors to their mean, rounded down; at last all are assigned again.
    distance is squared. n_exact counts the centroids measured exactly, which the compressed vectors and the norms of segments of `segment` components did not rule out.

    The whole numbers, the compressed vectors and the norms are written once. A round is one pass over that table; tasks send at most k sums, and k x dims
    totals reach the driver, which sends back k centroids: both are bounded by parameters. Fewer usable vectors than k give fewer centroids.
    Equal hashes are ordered by the vector; null ids come last as starts, but are assigned. Repeated rows count each time. Vectors whose numbers
    leave the whole numbers that a double holds exactly (2^53) are not usable; a squared distance beyond a long is given as the largest long.
    An empty table gives no rows. Other columns of the input are not looked at.
    """
    spark = vectors.sparkSession
    table = integer_vectors(vectors, id_col, vec_col, dims, scale, segment)
    starts = table.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("_of").cast("string")), 256).alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    centroids = np.array([r.x for r in starts], np.int64).reshape(-1, dims)
    name = unused(spark.createDataFrame([], "cluster int, distance long, n_exact int"), id_col)
    schema = f"`{name}` {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long, n_exact int"
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    for _ in range(rounds):
        sums = table.mapInArrow(_sums(Screen(centroids, segment), dims), "cluster int, sums array<string>, n long")
        each = sums.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in each.collect():
            centroids[r.cluster, r["at"]] = int(r.s) // r.n
    screen = Screen(centroids, segment)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, best, distance, exact in _blocks(batches, screen, dims):
            near = np.minimum(distance, LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("_of"), pa.array(best, pa.int32()), pa.array(near), pa.array(exact, pa.int32())], names=[name, "cluster", "distance", "n_exact"])

    return table.mapInArrow(assign, schema), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment, with the sum of distances of each cluster and of all, and a digest of the centroid."""
    found, centroids = cluster(read(spark, sf_dir, "embeddings"))
    found = scratch(found, "assigned")
    total = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    inertia = min(sum(total.values()), LARGEST)
    rows = [(c, min(total.get(c, 0), LARGEST), inertia, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int) -> str:
    nearest = f"""a{r} AS (SELECT id, vec_id, any_value(x) AS x, min(d * 64 + k) % 64 AS cluster, min(d * 64 + k) // 64 AS distance FROM (
  SELECT id, vec_id, v.x, k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept v, c{r} c) GROUP BY id, vec_id)"""
    if r == 5:
        return nearest
    return nearest + f""",
m{r} AS (SELECT cluster, list(m ORDER BY p) AS x FROM (SELECT cluster, p, CAST(floor(sum(x[p]) / count(*)) AS BIGINT) AS m FROM a{r}, range(1, 65) q(p) GROUP BY cluster, p) GROUP BY cluster),
c{r + 1} AS (SELECT k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.k)"""


OP11_SQL = f"""
WITH kept AS (SELECT row_number() OVER () AS id, vec_id, x FROM (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64)),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM kept ORDER BY h, x LIMIT 40)),
{", ".join(_round_sql(r) for r in range(6))}
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.k = a5.cluster
"""
