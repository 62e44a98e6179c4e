"""Comparison histories of images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RANKING


def sides(comparisons: DataFrame) -> DataFrame:
    """Two rows for each comparison: one for each image, with the other and whether it won."""
    side = F.explode(F.array(F.struct(F.col("filename_a").alias("filename"), F.col("filename_b").alias("other")), F.struct(F.col("filename_b").alias("filename"), F.col("filename_a").alias("other"))))
    return comparisons.withColumn("side", side).select(
        F.col("side.filename").alias("filename"), F.col("side.other").alias("other"), F.col("id").alias("comparison_id"), "timestamp", "weight", "transitive_depth",
        (F.col("winner") == F.col("side.filename")).alias("won"),
    )


def rows(comparisons: DataFrame, images: DataFrame) -> DataFrame:
    """The sides with the opponent's score; unknown opponents have the default."""
    scores = images.select(F.col("filename").alias("other"), F.col("score").alias("_s"))
    return sides(comparisons).join(scores, "other", "left").withColumn("opponent_score", F.coalesce("_s", F.lit(RANKING.default_score))).drop("_s")


def of_image(comparisons: DataFrame, images: DataFrame, filename: str) -> DataFrame:
    """One image's comparisons; the filter goes below the join."""
    touching = comparisons.where((F.col("filename_a") == filename) | (F.col("filename_b") == filename))
    return rows(touching, images).where(F.col("filename") == filename)


def arrays(comparisons: DataFrame, images: DataFrame) -> DataFrame:
    """(filename, history): structs by time and id. The array is bounded by the image's own comparisons."""
    item = F.struct("timestamp", "comparison_id", "other", "opponent_score", F.col("won").alias("winner"), "weight", "transitive_depth")
    return rows(comparisons, images).groupBy("filename").agg(F.sort_array(F.collect_list(item)).alias("history"))


def merge(keeper: DataFrame, discarded: DataFrame) -> DataFrame:
    """Histories (filename, comparison_id, ...) of a kept file and of its discarded copies.

    By comparison id, the keeper's row first; rows without an id stay only if the keeper has them.
    """
    both = keeper.withColumn("_o", F.lit(0)).unionByName(discarded.where("comparison_id is not null").withColumn("_o", F.lit(1)))
    known = both.where("comparison_id is not null")
    first = known.withColumn("_n", F.row_number().over(W.partitionBy("filename", "comparison_id").orderBy("_o", "timestamp"))).where("_n = 1").drop("_n")
    return first.unionByName(both.where("comparison_id is null")).drop("_o")


def wins_losses(comparisons: DataFrame) -> DataFrame:
    """(filename, wins, losses): different opponents beaten, and lost to."""
    s = sides(comparisons).where("filename <> other")
    return s.groupBy("filename").agg(F.count_distinct(F.when(F.col("won"), F.col("other"))).alias("wins"), F.count_distinct(F.when(~F.col("won"), F.col("other"))).alias("losses"))


def tallies(links: DataFrame) -> DataFrame:
    """wins_losses of links (winner, loser) that are different and join two images: a sum, which combines before its exchange."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    side = F.array(F.struct(F.col("winner").alias("filename"), one.alias("w"), none.alias("l")), F.struct(F.col("loser").alias("filename"), none.alias("w"), one.alias("l")))
    return links.select(F.inline(side)).groupBy("filename").agg(F.sum("w").alias("wins"), F.sum("l").alias("losses"))
