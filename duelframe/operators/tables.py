"""The images, comparisons and meta tables: scans, lookups, appends and updates as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RANKING, RATING


def pair_columns(a: str = "filename_a", b: str = "filename_b") -> tuple[Column, Column]:
    """The two names in order."""
    return F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))


def canonical(df: DataFrame) -> DataFrame:
    a, b = pair_columns()
    return df.withColumns({"filename_a": a, "filename_b": b})


def valid_winner(df: DataFrame) -> DataFrame:
    return df.where((F.col("winner") == F.col("filename_a")) | (F.col("winner") == F.col("filename_b")))


def loser() -> Column:
    return F.when(F.col("winner") == F.col("filename_a"), F.col("filename_b")).otherwise(F.col("filename_a"))


def with_loser(df: DataFrame) -> DataFrame:
    return df.withColumn("loser", loser())


def lookup(images: DataFrame, filename: str) -> DataFrame:
    """One image by its key; the filter reaches the scan."""
    return images.where(F.col("filename") == filename)


def insert_images(images: DataFrame, new: DataFrame) -> DataFrame:
    """images and the new rows whose filename is not there yet; of several new rows of a name, one."""
    fresh = new.dropDuplicates(["filename"]).join(images.select("filename"), "filename", "left_anti")
    return images.unionByName(fresh.select(*images.columns))


def update_ratings(images: DataFrame, updates: DataFrame, stamp: str = "set") -> DataFrame:
    """images with score, rating_mu and rating_sigma from updates (filename, score, rating_mu, rating_sigma, compared_at).

    stamp: "set" takes compared_at, "keep" leaves last_compared_at, "clear" makes it null. Counts go up by
    one unless the stamp is cleared. Images without an update stay as they are.
    """
    if stamp not in ("set", "keep", "clear"):
        raise ValueError(f"unknown stamp mode: {stamp}")
    u = updates.select("filename", *[F.col(c).alias(f"_{c}") for c in ("score", "rating_mu", "rating_sigma", "compared_at")], F.lit(True).alias("_hit"))
    j = images.join(u, "filename", "left")
    hit = F.col("_hit").isNotNull()
    when = {"set": F.coalesce("_compared_at", "last_compared_at"), "keep": F.col("last_compared_at"), "clear": F.lit(None).cast("timestamp")}[stamp]
    out = {c: F.coalesce(f"_{c}", c) for c in ("score", "rating_mu", "rating_sigma")}
    out["last_compared_at"] = F.when(hit, when).otherwise(F.col("last_compared_at"))
    out["comparison_count"] = F.when(hit & F.lit(stamp != "clear"), F.col("comparison_count") + 1).otherwise(F.col("comparison_count"))
    return j.withColumns(out).select(*images.columns)


def update_tags(images: DataFrame, tags: DataFrame) -> DataFrame:
    """images with prompt_tags from tags (filename, prompt_tags) where given."""
    t = tags.select("filename", F.col("prompt_tags").alias("_tags"))
    return images.join(t, "filename", "left").withColumn("prompt_tags", F.coalesce("_tags", "prompt_tags")).select(*images.columns)


def reset_ratings(images: DataFrame, score: float = RANKING.default_score) -> DataFrame:
    return images.withColumns(
        {
            "score": F.lit(score), "rating_mu": F.lit(RATING.mean), "rating_sigma": F.lit(RATING.deviation),
            "comparison_count": F.lit(0), "last_compared_at": F.lit(None).cast("timestamp"),
        }
    )


def truncated(df: DataFrame) -> DataFrame:
    """An empty table of the same columns."""
    return df.limit(0)


def scan_order() -> list[Column]:
    """By time and id; unknown times first."""
    return [F.asc_nulls_first("timestamp"), F.asc("id")]


def scan_comparisons(comparisons: DataFrame, weight: float | None = None) -> DataFrame:
    """By time and id; null times first."""
    rows = comparisons if weight is None else comparisons.where(F.col("weight") == weight)
    return rows.orderBy(*scan_order())


def append_comparisons(comparisons: DataFrame, new: DataFrame) -> DataFrame:
    """comparisons and the valid new rows, names in order."""
    return comparisons.unionByName(canonical(valid_winner(new)).select(*comparisons.columns))


def append_history(comparisons: DataFrame, new: DataFrame) -> DataFrame:
    """Like append_comparisons, without rows that equal one that is there in all but the id."""
    keys = ["filename_a", "filename_b", "winner", "timestamp", "weight", "transitive_depth"]
    fresh = canonical(valid_winner(new)).dropDuplicates(keys)
    same = [fresh[k].eqNullSafe(comparisons[k]) for k in keys]
    return comparisons.unionByName(fresh.join(comparisons, same, "left_anti").select(*comparisons.columns))


def existing_pairs(pairs: DataFrame, comparisons: DataFrame) -> DataFrame:
    """The pairs that have been compared at least once."""
    known = canonical(comparisons).select("filename_a", "filename_b")
    return canonical(pairs).join(known, ["filename_a", "filename_b"], "left_semi")


def counts(images: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row: images, comparisons, skipped comparisons (weight under 1)."""
    c = comparisons.agg(F.count("*").alias("comparisons"), F.count_if(F.col("weight") < 1).alias("skipped"))
    return images.agg(F.count("*").alias("images")).crossJoin(c)


def upsert_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value): the changes win."""
    both = meta.select("key", "value", F.lit(0).alias("o")).union(changes.select("key", "value", F.lit(1)))
    return both.groupBy("key").agg(F.max_by("value", "o").alias("value"))


def only_winners(comparisons: DataFrame) -> DataFrame:
    """Images that have won and never lost."""
    c = with_loser(comparisons)
    return c.select(F.col("winner").alias("filename")).subtract(c.select("loser"))


def only_losers(comparisons: DataFrame) -> DataFrame:
    c = with_loser(comparisons)
    return c.select(F.col("loser").alias("filename")).subtract(c.select("winner"))


def nodes(comparisons: DataFrame) -> DataFrame:
    return comparisons.select(F.col("filename_a").alias("filename")).union(comparisons.select("filename_b")).distinct()


def link_set(comparisons: DataFrame) -> DataFrame:
    """The different unordered pairs."""
    return canonical(comparisons).select("filename_a", "filename_b").distinct()


def keep_ids(df: DataFrame, kept: DataFrame) -> DataFrame:
    return df.join(kept.select("id"), "id", "left_semi")


def exclude(images: DataFrame, names: DataFrame) -> DataFrame:
    return images.join(names.select("filename"), "filename", "left_anti")


def rank_within(df: DataFrame, key: str, order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)))
