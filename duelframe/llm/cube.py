"""Mixing sources to target weights by balanced sampling with the cube method (operator 13)."""

from __future__ import annotations

from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ordinals, places, read, scratch

_BLOCK = 256  # documents of a block of the first round
_MERGE = 32  # blocks, each with eight undecided documents or so, that form one of the next round
_LEFT = 8
_LANDING = 12  # undecided documents of a source that land together
_FLIGHTS = 16
_NEAR = 1e-9


def words(text: Column) -> Column:
    """The number of runs of other characters than blank and tab to carriage return; 0 for null."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def _move(p: np.ndarray, u: np.ndarray, rng: Random) -> None:
    """p moved along u, up or down, until a component is 0 or 1; the mean of the two outcomes is p."""
    with np.errstate(divide="ignore"):
        room = np.where(u > 0, (1 - p) / np.abs(u), p / np.abs(u)), np.where(u > 0, p / np.abs(u), (1 - p) / np.abs(u))
    moving = np.abs(u) > _NEAR
    up, down = float(room[0][moving].min()), float(room[1][moving].min())
    p += (up if rng.random() * (up + down) < down else -down) * u
    p[p < _NEAR] = 0.0
    p[p > 1 - _NEAR] = 1.0


def flight(p: np.ndarray, sizes: np.ndarray, rng: Random, rest: int = _LEFT) -> np.ndarray:
    """Probabilities moved to 0 or 1 within the null space of the constraints: the sum of p and the sum of p * sizes stay.

    Each step moves the largest undecided document that can move, together with what of its direction the constraints leave: its
    unit vector projected onto the null space over all undecided ones. It ends with `rest` undecided ones or fewer (or with those that cannot
    move, two at most), which are small ones wherever the sizes allow.
    """
    p, at = p.copy(), np.argsort(-sizes, kind="stable")
    while True:
        at = at[(p[at] > 0) & (p[at] < 1)]
        if len(at) <= rest:
            return p
        s = sizes[at].astype(np.float64)
        off = s - s.mean()
        spread = float((off**2).sum())
        held = 1 / len(at) + (off**2 / spread if spread > 0 else 0 * off)
        free = np.flatnonzero(held < 1 - _NEAR)
        if not len(free):
            return p
        a = free[0]
        u = -1 / len(at) - (off[a] * off / spread if spread > 0 else 0 * off)
        u[a] += 1
        mine = p[at]
        _move(mine, u / np.abs(u).max(), rng)
        p[at] = mine


def land(p: np.ndarray, sizes: np.ndarray, rng: Random) -> np.ndarray:
    """A flight down to the last _LANDING documents, for which the subset nearest to both totals is taken, the sizes' first.

    A large document without others near its size can stay to the end and miss the total; so the best of up to _FLIGHTS flights is taken.
    """
    words, docs, best, miss = float((p * sizes).sum()), float(p.sum()), p, np.inf
    for _ in range(_FLIGHTS):
        q = flight(p, sizes, rng, _LANDING)
        at = np.flatnonzero((q > 0) & (q < 1))
        subsets = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        q[at] = 0
        off = np.abs(subsets @ sizes[at] + float((q * sizes).sum()) - words)
        cost = off + np.minimum(np.abs(subsets.sum(1) + float(q.sum()) - docs), 1000) / 1000
        k = int(cost.argmin())
        q[at] = subsets[k]
        if cost[k] < miss:
            best, miss = q, float(cost[k])
        if miss < 2:
            break
    return best


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(key, source_size, n, target): all sizes shared by the sources' weights, in the order of keys and repeating, but at most `most` times a source's own.

    What is above goes to the others by weight. A share a weight only ever grows, so each round is one sum over the
    written table of sources, and two numbers reach the driver.
    """
    parts = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked = ordinals(sources.repartitionByRange(parts, "key").sortWithinPartitions("key"), "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = scratch(ranked.withColumn("w", weight).select("key", "source_size", "n", "w"), "sources")
    total = int(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    share = 0.0
    while True:
        full = F.col("source_size") * F.lit(most) <= F.col("w") * F.lit(share)
        r = table.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)).alias("w")).first()
        following = (total - most * int(r["full"])) / r.w if r.w else share
        if following <= share:
            break
        share = following
    return table.select("key", "source_size", "n", F.least(F.col("w") * F.lit(share), F.col("source_size") * F.lit(most)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 13) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each document: how often the mix takes it whole, and the words that makes.

    size counts words; a source's target is its share of all words by its weight (sources by code point, null last, take the weights in turn), at most
    `most` times its own words. With m = target / source_size a document is taken floor(m) times, and once more with the probability of
    the rest, by the cube method: probabilities move within the null space of "words taken" and "documents taken" of the source, so
    both stay at their targets until at most twelve documents of a source are undecided, of which the subset nearest to the totals lands.

    Sources are cut into blocks of 256 documents that span all sizes; the undecided of up to 32 blocks form a block of the next round, until a
    source is one block. A hot source is many blocks. Chance comes from the seed, the source and the block, and blocks
    from places in the order of sizes and ids, so neither reruns nor partitioning change the result. Null and empty texts have size 0 and are
    drawn like others; a source without words has target 0 and takes nothing; rows with a null id, and repeated rows, are documents of their own.
    An empty table gives no rows; other columns are not looked at.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col(f"`{source_col}`").cast("string")), F.lit("1"))
    rows = scratch(docs.select(F.col(f"`{id_col}`").alias("_of"), F.col(f"`{source_col}`").alias("_source"), key.alias("key"), words(F.col(f"`{text_col}`")).alias("size")), "sizes")
    sources = scratch(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most), "targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    table = sources.select(F.col("key").alias("_key"), F.ceil(F.col("n") / _BLOCK).alias("blocks"), F.floor(times + _NEAR).alias("whole"), F.greatest(times - F.floor(times + _NEAR), F.lit(0.0)).alias("p"))
    state = places(rows, "key", F.desc("size"), F.asc("_of")).join(table, F.col("key") == F.col("_key")).drop("_key")
    state = state.withColumn("block", F.col("place") % F.col("blocks"))
    schema = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in state.columns)
    sure = F.col("p").isin(0.0, 1.0)
    done, left, turn = [state.where(sure)], state.where(~sure), 0

    def fly(turn: int):
        def run(of: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by([("size", "descending"), ("place", "ascending")])
            rng = Random(crc32(f"{seed}|{turn}|{of[0].as_py()}|{of[1].as_py()}".encode()))
            last = group.column("blocks")[0].as_py() == 1
            p = (land if last else flight)(group.column("p").to_numpy(), group.column("size").to_numpy(), rng)
            return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p))

        return run

    while True:
        flown = scratch(left.groupBy("key", "block").applyInArrow(fly(turn), schema), "flown")
        done.append(flown.where(sure))
        left = flown.where(~sure)
        if left.isEmpty():
            break
        left, turn = left.withColumns({"block": F.floor(F.col("block") / _MERGE), "blocks": F.ceil(F.col("blocks") / _MERGE)}), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    copies = F.col("whole") + F.col("p").cast("long")
    return out.join(sources, "key").select(F.col("_of").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
