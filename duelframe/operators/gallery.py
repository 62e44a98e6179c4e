"""The gallery: range filters, tag search, sort orders and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sort orders; the filename settles ties.
SORTS = {
    "score_desc": lambda: [F.desc("score")],
    "score_asc": lambda: [F.asc("score")],
    "comparisons_desc": lambda: [F.desc("comparison_count")],
    "comparisons_asc": lambda: [F.asc("comparison_count")],
    "last_compared_asc": lambda: [F.asc_nulls_last("last_compared_at")],
    "last_compared_desc": lambda: [F.desc_nulls_last("last_compared_at")],
    "newest": lambda: [F.desc("filename")],
}


def page_bounds(page: int, per_page: int) -> tuple[int, int]:
    """(offset, limit): pages from 1; a page size outside 1 .. 100 becomes 20."""
    per_page = per_page if 1 <= per_page <= 100 else 20
    return (max(page, 1) - 1) * per_page, per_page


def in_range(images: DataFrame, score: tuple[float, float] = (0.0, 1.0), comparisons: tuple[int, int] | None = None) -> DataFrame:
    out = images.where(F.col("score").between(*score))
    return out if comparisons is None else out.where(F.col("comparison_count").between(*comparisons))


def _hits(tags: list[str]) -> list[Column]:
    text = F.lower(F.concat_ws(" ", F.coalesce("prompt_tags", F.lit("")), "filename"))
    return [text.contains(t.strip().lower()) for t in tags if t.strip()]


def tagged(images: DataFrame, tags: list[str], mode: str = "and") -> DataFrame:
    """Images whose tags or name contain all ("and") or any ("or") of the tags; "both": block 0 has all, block 1 only some."""
    hits = _hits(tags)
    if not hits:
        return images.withColumn("block", F.lit(0))
    every, some = reduce(lambda a, b: a & b, hits), reduce(lambda a, b: a | b, hits)
    if mode == "and":
        return images.where(every).withColumn("block", F.lit(0))
    if mode == "or":
        return images.where(some).withColumn("block", F.lit(0))
    return images.where(some).withColumn("block", F.when(every, 0).otherwise(1))


def page(images: DataFrame, sort: str = "score_desc", number: int = 1, per_page: int = 20) -> DataFrame:
    offset, limit = page_bounds(number, per_page)
    order = ([F.asc("block")] if "block" in images.columns else []) + SORTS[sort]() + [F.asc("filename")]
    return images.orderBy(*order).offset(offset).limit(limit)


def gallery(images: DataFrame, tags: list[str], mode: str = "both", score: tuple[float, float] = (0.0, 1.0), comparisons: tuple[int, int] | None = None, sort: str = "score_desc", number: int = 1, per_page: int = 20) -> DataFrame:
    """One page of what matches: range filter, tag search, sort, page."""
    return page(tagged(in_range(images, score, comparisons), tags, mode), sort, number, per_page)


def by_filename(images: DataFrame, part: str, score: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    return in_range(images, score).where(F.lower("filename").contains(part.lower()))


def newest_batch(files: DataFrame, time: str, reserve: int, batch: int) -> DataFrame:
    """After the `reserve` newest, the next `batch`."""
    return files.orderBy(F.desc(time), "filename").offset(reserve).limit(batch)


def most_compared(images: DataFrame) -> DataFrame:
    return images.agg(F.coalesce(F.max("comparison_count"), F.lit(0)).alias("max_comparisons"))
