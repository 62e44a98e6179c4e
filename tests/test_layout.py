"""Stored tables: added columns, joins without exchange, pruned buckets, compaction."""

import pytest
from pyspark.sql import functions as F

from duelframe import schemas
from duelframe.operators import layout, tables
from duelframe.plans import layouts
from duelframe.plans.base import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_added_columns_answer_with_defaults(spark, tmp_path):
    old = spark.createDataFrame([("a", 0.5), ("b", None), (None, 0.1)], "filename string, score double")
    layout.bucketed(old, "old_images", f"file://{tmp_path}/t", ["filename"], 4)
    files = sorted(tmp_path.rglob("*.parquet"))
    added = layout.migrate(spark, "old_images", schemas.IMAGES, layout.DEFAULTS["images"])
    assert added == ["rating_mu", "rating_sigma", "comparison_count", "last_compared_at", "ranking_generation", "prompt_tags"]
    assert sorted(tmp_path.rglob("*.parquet")) == files  # nothing is rewritten
    assert layout.migrate(spark, "old_images", schemas.IMAGES, layout.DEFAULTS["images"]) == []
    layout.append(spark.createDataFrame([(9, "c", 1.0)], "extra int, filename string, rating_mu double"), "old_images")
    got = {r.filename: r for r in spark.table("old_images").collect()}
    assert (got["a"].score, got["a"].rating_mu, got["a"].rating_sigma, got["a"].comparison_count, got["a"].prompt_tags) == (0.5, 25.0, 25 / 3, 0, None)
    assert got["b"].score is None and got[None].rating_mu == 25.0
    assert (got["c"].rating_mu, got["c"].score, got["c"].comparison_count) == (1.0, None, 0)  # score had no default when it was made
    with pytest.raises(ValueError, match="score is double, not string"):
        layout.migrate(spark, "old_images", "score string")


def test_joins_and_groups_by_the_bucket_need_no_exchange(spark):
    t = Tables(spark, SF)
    text = plan(layouts.s15_bucketed_join(t))
    assert "Exchange" not in text and "SortMergeJoin" in text


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    images = Tables(spark, SF).images
    stored = layout.bucketed(images, "looked_up", f"file://{tmp_path}/t", ["filename"], 8)
    name = images.agg(F.min("filename")).first()[0]
    (path,) = stored.where(F.col("filename") == name).select("_metadata.file_path").first()
    for other in tmp_path.rglob("*.parquet"):
        if other.name != path.rsplit("/", 1)[1]:
            other.unlink()
    found = tables.lookup(stored, name)
    assert "EqualTo(filename" in plan(found) and [r.filename for r in found.collect()] == [name]


def test_compaction_rewrites_crowded_partitions_alone(spark, tmp_path):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, "x y").when(F.col("id") % 4 == 1, "b").when(F.col("id") % 4 == 2, "c").alias("k"))
    layout.partitioned(rows.where("k <> 'c' or k is null").repartition(5), "crowd", f"file://{tmp_path}/t", ["k"])
    layout.append(rows.where("k = 'c'").coalesce(1), "crowd")
    c_before = {r[0] for r in spark.table("crowd").where("k = 'c'").select("_metadata.file_path").distinct().collect()}
    want = sorted(map(tuple, rows.select("id", "k").collect()))
    assert layout.compact(spark, "crowd", f"file://{tmp_path}/new", "k") == 3
    assert {r.k: r.files for r in layout.file_sizes(spark.table("crowd"), ["k"]).collect()} == {None: 1, "x y": 1, "b": 1, "c": 1}
    assert sorted(map(tuple, spark.table("crowd").select("id", "k").collect())) == want
    assert {r[0] for r in spark.table("crowd").where("k = 'c'").select("_metadata.file_path").distinct().collect()} == c_before
    assert layout.compact(spark, "crowd", f"file://{tmp_path}/new", "k") == 0
    size = layout.file_sizes(spark.table("crowd").where("k = 'b'"), ["k"]).first().bytes
    layout.append(rows.where("k = 'b'").select((F.col("id") + 9000).alias("id"), "k").repartition(6), "crowd")
    assert layout.compact(spark, "crowd", f"file://{tmp_path}/new", "k", target=size) == 1
    assert 2 <= layout.file_sizes(spark.table("crowd").where("k = 'b'"), ["k"]).first().files <= 4
    assert spark.table("crowd").count() == 5000
    assert tables.counts(spark.table("crowd"), spark.createDataFrame([], "weight double")).first().images == 5000


def test_compaction_writes_as_many_files_as_the_bytes_need(spark, tmp_path):
    """Two files' rows dealt to one task would be one file above the target."""
    rows = [spark.range(k, 60_000, 6).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0.5).alias("k")).coalesce(1) for k in range(6)]
    layout.partitioned(rows[0], "long", f"file://{tmp_path}/t", ["k"])
    for more in rows[1:]:
        layout.append(more, "long")
    target = layout.file_sizes(spark.table("long"), ["k"]).first().bytes // 4
    assert layout.compact(spark, "long", f"file://{tmp_path}/new", "k", target) == 1
    after = layout.file_sizes(spark.table("long"), ["k"]).first()
    assert after.files == -(-after.bytes // target) > 3
    assert max(p.stat().st_size for p in tmp_path.glob("new/*/*/*.parquet")) < 1.05 * target
    assert layout.compact(spark, "long", f"file://{tmp_path}/new", "k", target) == 0
    assert spark.table("long").count() == 60_000
