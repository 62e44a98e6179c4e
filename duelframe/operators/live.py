"""One comparison recorded: ratings, scores, the appended row, what sidecars have to follow, and component labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rating_math import public_score, update_columns
from . import graph, tables


@dataclass(frozen=True)
class Recorded:
    images: DataFrame
    comparisons: DataFrame
    sync: DataFrame  # (filename, score, rating_mu, rating_sigma, comparison_count) of the two images, for their sidecars
    labels: DataFrame | None


def record(images: DataFrame, comparisons: DataFrame, new: DataFrame, labels: DataFrame | None = None) -> Recorded:
    """The tables after a new comparison (filename_a, filename_b, winner, weight, timestamp, transitive_depth), a single row.

    Both images get new ratings, public scores and the comparison's time, and their counts go up; the comparison is
    appended under the next id; component labels are merged if given. A winner that took no part, an image against
    itself and unknown images change nothing. Both rows are found by key, so the filters reach the scan.
    """
    known = images.select("filename", "rating_mu", "rating_sigma")
    w = known.select(F.col("filename").alias("winner"), F.col("rating_mu").alias("mw"), F.col("rating_sigma").alias("sw"))
    lo = known.select(F.col("filename").alias("loser"), F.col("rating_mu").alias("ml"), F.col("rating_sigma").alias("sl"))
    valid = tables.with_loser(tables.valid_winner(tables.canonical(new))).where("winner <> loser").limit(1)
    both = valid.join(w, "winner").join(lo, "loser")
    after = both.select("winner", "loser", "timestamp", *[c.alias(n) for n, c in update_columns(F.col("mw"), F.col("sw"), F.col("ml"), F.col("sl")).items()])
    sides = F.explode(F.array(*[F.struct(F.col(name).alias("filename"), F.col(f"new_mu_{k}").alias("rating_mu"), F.col(f"new_sigma_{k}").alias("rating_sigma")) for name, k in (("winner", "w"), ("loser", "l"))]))
    updates = after.select(sides.alias("u"), F.col("timestamp").alias("compared_at")).select("u.*", "compared_at")
    updates = updates.withColumn("score", public_score(F.col("rating_mu"), F.col("rating_sigma")))
    out = tables.update_ratings(images, updates, "set")
    last = comparisons.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    row = both.drop("id").crossJoin(last).withColumn("id", F.col("last") + 1).select(*comparisons.columns)
    link = both.select("winner", "loser")
    sync = out.join(updates.select("filename"), "filename", "left_semi").select("filename", "score", "rating_mu", "rating_sigma", "comparison_count")
    return Recorded(out, comparisons.unionByName(row), sync, None if labels is None else graph.merge_edges(labels, link))
