"""Connected components of an undirected graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch
from .ordering import dense_order


def _turned(x: Column, bits: int) -> Column:
    """A long whose bits are rotated: another order of the same ids, and none is lost."""
    bits %= 64
    return x if bits == 0 else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


_FEW = 100_000  # links that one task settles


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, m) of links (u, v): m is the smallest end of u's component, by joined trees."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            x, y = root(u), root(v)
            up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(up.keys(), pa.int64()), pa.array([root(x) for x in up], pa.int64())], names=["u", "m"])


def contracted(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, m) for every end of the links (u, v), two longs: m is one end of u's component, the same for all of it; a link of a node to itself adds the node.

    In each round every node goes to the first of itself and its neighbours, in an order that changes by the round; links between the nodes gone to
    are left, so both shrink by a factor and all rounds together cost little more than the first; once few links are left, one task settles them. Then the
    steps are followed from the last round back.
    No node's neighbours are collected: a round is a groupBy-min, which combines before its exchange and is written, and joins with what was written,
    of which adaptive execution splits a hub's side.
    """
    e = scratch(links.select("u", "v"), "links")
    left, steps = e.count(), []
    while left > _FEW:
        if len(steps) == rounds:
            raise RuntimeError("components did not converge")
        bits = 23 * len(steps)
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x"))
        least = both.groupBy(F.col("x.u").alias("u")).agg(F.min(_turned(F.col("x.v"), bits)).alias("t"))
        to = scratch(least.select("u", _turned(F.least("t", _turned(F.col("u"), bits)), 64 - bits % 64).alias("m")), "steps")
        steps.append(to)
        ends = e.where("u <> v").join(to.withColumnRenamed("m", "mu"), "u").join(to.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
        e = scratch(ends.where("mu <> mv").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct(), "links")
        left = e.count()
    if left or not steps:
        steps.append(scratch(e.coalesce(1).mapInArrow(_settled, "u long, m long"), "steps"))
    out = steps.pop()
    while steps:
        out = steps.pop().join(out.select(F.col("u").alias("m"), F.col("m").alias("far")), "m", "left").select("u", F.coalesce("far", "m").alias("m"))
    return out


def hashed(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v): 64-bit hashes of the ends of each edge; a null end is replaced by the other one."""
    e = edges.where(F.col(a).isNotNull() | F.col(b).isNotNull())
    return e.select(F.xxhash64(F.coalesce(a, b)).alias("u"), F.xxhash64(F.coalesce(b, a)).alias("v"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every endpoint; component is the smallest node reachable.

    The rounds (see contracted) run on 64-bit hashes of the nodes; should two nodes have the same one, which shows in there being fewer hashes than
    nodes, nodes are numbered instead. Nulls and self-links add nothing but the node.
    """
    ends = edges.select(F.explode(F.array(a, b)).alias("node")).where("node is not null").distinct()
    ids = scratch(ends.select("node", F.xxhash64("node").alias("id")), "ids")
    parts = scratch(contracted(hashed(edges, a, b), rounds), "hashed-parts")
    if ids.count() != parts.count():
        ids = scratch(dense_order(ids.select("node"), "node", name="id"), "ids")
        at = [ids.select(F.col("node").alias(f"_{k}"), F.col("id").alias(k)) for k in "uv"]
        named = edges.select(F.coalesce(a, b).alias("_u"), F.coalesce(b, a).alias("_v"))
        parts = contracted(named.join(at[0], "_u").join(at[1], "_v").select("u", "v"), rounds)
    own = scratch(ids.join(parts.withColumnRenamed("u", "id"), "id").select("node", "m"), "parts")
    return own.join(scratch(own.groupBy("m").agg(F.min("node").alias("component")), "least"), "m").select("node", "component")
