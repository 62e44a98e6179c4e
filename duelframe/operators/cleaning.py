"""Cleaning of comparison histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import canonical


def flagged(comparisons: DataFrame, images: DataFrame) -> DataFrame:
    """Each comparison with what becomes of it: missing, self, duplicate, contradiction or kept.

    The latest row (time, then id; null times first) of a pair and winner stays, then the latest of the pair.
    """
    known = images.select("filename").distinct()
    a, b = known.select(F.col("filename").alias("filename_a"), F.lit(True).alias("_a")), known.select(F.col("filename").alias("filename_b"), F.lit(True).alias("_b"))
    rows = canonical(comparisons.join(a, "filename_a", "left").join(b, "filename_b", "left"))
    rows = rows.withColumn("_in", F.col("_a").isNotNull() & F.col("_b").isNotNull()).withColumn("_self", F.col("filename_a") == F.col("filename_b"))
    latest = [F.desc_nulls_last("timestamp"), F.desc("id")]
    usable = F.col("_in") & ~F.col("_self")
    by_winner, by_pair = W.partitionBy("filename_a", "filename_b", "_ok", "winner"), W.partitionBy("filename_a", "filename_b", "_ok")
    rows = rows.withColumn("_ok", usable).withColumn("_w", F.row_number().over(by_winner.orderBy(*latest))).withColumn("_p", F.row_number().over(by_pair.orderBy(*latest)))
    fate = F.when(~F.col("_in"), "missing").when(F.col("_self"), "self").when(F.col("_w") > 1, "duplicate").when(F.col("_p") > 1, "contradiction").otherwise("kept")
    return rows.withColumn("fate", fate).select(*comparisons.columns, "fate")


def clean(comparisons: DataFrame, images: DataFrame) -> DataFrame:
    return flagged(comparisons, images).where("fate = 'kept'").drop("fate")


def counters(comparisons: DataFrame, images: DataFrame) -> DataFrame:
    """One row with the number of rows of each fate."""
    names = {"missing": "missing_nodes_removed", "self": "self_links_removed", "duplicate": "same_direction_duplicates_removed", "contradiction": "contradictions_removed", "kept": "kept"}
    return flagged(comparisons, images).agg(*[F.count_if(F.col("fate") == k).alias(v) for k, v in names.items()])
