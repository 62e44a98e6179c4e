"""Streams: polled files, names seen before, and ratings that follow the comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RANKING, RATING
from ..functions.rating_math import update


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder, so many per micro-batch; a path that is one file is that file of its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def new_names(stream: DataFrame, key: str = "filename", time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each name once; with a time column, names are remembered as long as rows may be late."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def recent(stream: DataFrame, group: str, name: str, most: int = RANKING.recent_items) -> DataFrame:
    """(group, recent): the last `most` names of each group, kept as bounded state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            for n in pdf[name]:
                if n in held:
                    held.remove(n)
                held.append(n)
        held = held[-most:]
        state.update((held,))
        yield pd.DataFrame({group: [key[0]], "recent": [held]})

    return stream.groupBy(group).applyInPandasWithState(run, f"{group} string, recent array<string>", "held array<string>", "update", GroupStateTimeout.NoTimeout)


def live_ratings(stream: DataFrame, pool: str = "pool") -> DataFrame:
    """(pool, filename, mu, sigma, n) after each micro-batch, for a stream (pool, id, winner, loser).

    A pool is a set of images that are only compared among themselves; its ratings are one group's state.
    Within a micro-batch comparisons apply by id; only images that changed are given out.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {n: (m, s, int(c)) for n, m, s, c in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("id")
        fresh = (RATING.mean, RATING.deviation, 0)
        touched = {}
        for w, lo in zip(rows["winner"], rows["loser"], strict=True):
            a, b = held.get(w, fresh), held.get(lo, fresh)
            (ma, sa), (mb, sb) = update(a[:2], b[:2])
            held[w], held[lo] = (ma, sa, a[2] + 1), (mb, sb, b[2] + 1)
            touched[w] = touched[lo] = True
        names = list(held)
        state.update((names, *([held[n][i] for n in names] for i in range(3))))
        yield pd.DataFrame([(key[0], n, *held[n]) for n in touched], columns=[pool, "filename", "mu", "sigma", "n"])

    out = f"{pool} string, filename string, mu double, sigma double, n long"
    kept = "names array<string>, mu array<double>, sigma array<double>, n array<long>"
    return stream.select(pool, "id", "winner", "loser").groupBy(pool).applyInPandasWithState(run, out, kept, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """(start, key, n) by tumbling window; an addition of this engine, with late rows dropped."""
    w = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), key, "n")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what is there now into an in-memory table, for tests and catch-up."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def grow_graph(stream: DataFrame, apply, checkpoint: str, seconds: int = 30):
    """Calls apply(batch, id) for each micro-batch of new links; merge_edges keeps component labels up to date there."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
