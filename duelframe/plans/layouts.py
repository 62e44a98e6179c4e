"""Queries of stored tables: migrated columns, joins and lookups by buckets, compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout, tables
from ..scratch import scratch, shared_folder
from .base import Tables, query

BUCKETS = 16


def _new(t: Tables, name: str) -> tuple[str, str]:
    """A table name and its folder, of this call alone."""
    own = f"{name}_{uuid.uuid4().hex}"
    return own, f"{shared_folder(t.spark)}/{own}"


@query("""SELECT filename, score, CASE WHEN old THEN CAST(25 AS DOUBLE) ELSE rating_mu END AS rating_mu, CASE WHEN old THEN CAST(25 AS DOUBLE) / 3 ELSE rating_sigma END AS rating_sigma,
comparison_count, last_compared_at, CASE WHEN old THEN 0 ELSE ranking_generation END AS ranking_generation, CASE WHEN old THEN NULL ELSE prompt_tags END AS prompt_tags
FROM (SELECT *, score <= 0.5 AS old FROM images)""", "images")
def s15_migrated_images(t: Tables):
    """Images stored before there were ratings, then all columns added with their defaults, then the others appended."""
    name, path = _new(t, "images")
    before = t.images.where("score <= 0.5").select("filename", "score", "comparison_count", "last_compared_at")
    layout.bucketed(before, name, path, ["filename"], BUCKETS)
    layout.migrate(t.spark, name, t.images.schema, layout.DEFAULTS["images"])
    layout.append(t.images.where("score > 0.5"), name)
    return t.spark.table(name).select(*t.images.columns)


@query("""SELECT c.id, c.winner, i.score, n.wins FROM comparisons c JOIN images i ON c.winner = i.filename
JOIN (SELECT winner, count(*) AS wins FROM comparisons GROUP BY 1) n ON n.winner = c.winner""", "images", "comparisons")
def s15_bucketed_join(t: Tables):
    """Each comparison with its winner's score and number of wins, from tables bucketed by that name: no exchange."""
    (name, path), (other, place) = _new(t, "images"), _new(t, "comparisons")
    images = layout.bucketed(t.images, name, path, ["filename"], BUCKETS)
    won = layout.bucketed(t.comparisons, other, place, ["winner"], BUCKETS)
    return winners(won, images)


def winners(won: DataFrame, images: DataFrame) -> DataFrame:
    wins = won.groupBy("winner").agg(F.count("*").alias("wins"))
    scores = images.select(F.col("filename").alias("winner"), "score").hint("merge")
    return won.select("id", "winner").join(scores, "winner").join(wins.hint("merge"), "winner").select("id", "winner", "score", "wins")


@query("SELECT * FROM images WHERE filename = 'img_00000042'", "images")
def s02_bucketed_lookup(t: Tables):
    """One image by its name from a bucketed table: one bucket is read."""
    return tables.lookup(layout.bucketed(t.images, *_new(t, "images"), ["filename"], BUCKETS), "img_00000042")


@query("SELECT weight, count(*) AS rows, sum(id) AS ids, CAST(1 AS BIGINT) AS files FROM comparisons GROUP BY 1", "comparisons")
def s17_compaction(t: Tables):
    """Comparisons partitioned by weight and stored in several appends, then compacted to one file of at most 256 MB for each such size."""
    name, path = _new(t, "comparisons")
    rows = scratch(t.comparisons, "comparisons")
    layout.partitioned(rows.where("id % 3 = 0"), name, path, ["weight"])
    for k in (1, 2):
        layout.append(rows.where(f"id % 3 = {k}").repartition(3), name)
    layout.compact(t.spark, name, f"{path}_compacted", "weight")
    stored = t.spark.table(name)
    sizes = layout.file_sizes(stored, ["weight"])
    sums = stored.groupBy("weight").agg(F.count("*").alias("rows"), F.sum("id").cast("decimal(38,0)").alias("ids"))
    return sums.join(sizes, "weight").select("weight", "rows", "ids", (F.col("files") - layout.files_needed(256 << 20) + 1).cast("long").alias("files"))
