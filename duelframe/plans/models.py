"""Queries of models, images and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ranking, training
from ..scratch import scratch, shared_folder
from ..streaming import ingest, keyed
from .base import Tables, query


def _rows(t: Tables):
    x = F.transform("embedding", lambda v: v.cast("double"))
    score = F.expr("least(1.0, greatest(0.0, 0.5 + vector[0] + 0.5 * vector[1] * vector[2]))")
    return t.embeddings.select(F.col("vec_id").alias("id"), x.alias("vector"), "label").withColumn("score", score)


@query("SELECT vec_id AS id, substr(md5(concat(CAST(vec_id AS VARCHAR), ':947')), 1, 8) < '33333333' AS is_test FROM embeddings")
def m02_split(t: Tables):
    return training.split(_rows(t)).select("id", "is_test")


@query()
def m01_m03_m10_m11_regression(t: Tables):
    """Boosting that stops early on the test rows; their predictions, calibrated."""
    df = training.split(_rows(t))
    model = training.fit(df, "regression", training.Setting(max_iter=5, max_depth=3), validation="is_test")
    return training.calibrated(scratch(training.predict(model, df.where("is_test").select("id", "vector", "score")).select("id", "score", "prediction"), "predicted"))


@query()
def m01_binary(t: Tables):
    df = _rows(t).withColumn("good", (F.col("score") > 0.5).cast("double"))
    return training.predict(training.fit(df, "binary", training.Setting(max_iter=3, max_depth=3), "good"), df.select("id", "vector"), "binary").select("id", "prediction")


@query()
def m12_end_to_end(t: Tables):
    """The vectors worth taking, by a model of those of five labels."""
    rows = _rows(t)
    found = training.end_to_end(rows.select("id"), rows.select("id", "vector"), rows.where("label < 5").select("id", "score"), 0.6, 5, 40, training.Setting(max_iter=4, max_depth=3))
    return found.select("id", "calibrated")


@query()
def m01_multiclass(t: Tables):
    df = _rows(t).withColumn("label", F.floor(F.col("score") * 3).cast("double"))
    model = training.fit(df, "multiclass", training.Setting(max_iter=5, max_depth=3), "label")
    return training.predict(model, df.select("id", "vector"), "multiclass")


@query()
def m05_rank(t: Tables):
    rows = _rows(t)
    v = rows.select(F.col("id").cast("string").alias("id"), "vector")
    c = rows.select(F.col("id").cast("long").alias("id"), F.col("id").cast("string").alias("filename_a"), (F.col("id") + 1).cast("string").alias("filename_b"), "score")
    c = c.withColumn("winner", F.when(F.col("score") > 0.5, F.col("filename_a")).otherwise(F.col("filename_b"))).withColumn("weight", F.lit(1.0))
    d = training.differences(c, v).withColumnRenamed("features", "vector")
    return training.predict(training.fit(d, "rank", label="label"), rows.select("id", "vector"), "rank").select("id", "prediction")


def _duels(t: Tables, rows):
    """Every image against three others, by distance of id; the better one wins."""
    c = rows.select(F.col("id").cast("long").alias("a"), F.explode(F.array(*[F.lit(k) for k in (1, 17, 113)])).alias("k"), F.col("worth").alias("wa"))
    j = c.join(rows.select(F.col("id").cast("long").alias("b"), F.col("worth").alias("wb")), F.col("a") + F.col("k") == F.col("b"))
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    return j.select((F.col("a") * 1000 + F.col("k")).alias("id"), a.alias("filename_a"), b.alias("filename_b"), F.when(F.col("wa") >= F.col("wb"), a).otherwise(b).alias("winner"), F.lit(1.0).alias("weight"))


def _worth(t: Tables):
    """Vectors whose worth is an interaction, which no linear model ranks."""
    return _rows(t).where("vector is not null").withColumn("worth", F.expr("vector[0] * vector[1]"))


@query("""WITH v AS (SELECT vec_id AS a, CAST(embedding[1] AS DOUBLE) * CAST(embedding[2] AS DOUBLE) AS w, CAST(embedding[3] AS DOUBLE) AS raw FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT CASE WHEN x.w >= y.w THEN x.a ELSE y.a END AS winner, CASE WHEN x.w >= y.w THEN y.a ELSE x.a END AS loser, CASE WHEN x.w >= y.w THEN x.raw - y.raw ELSE y.raw - x.raw END AS m FROM v x, unnest([1, 17, 113]) q(k), v y WHERE y.a = x.a + k),
u AS (SELECT *, 1 / (1 + exp(m)) AS u FROM p)
SELECT CAST(id AS VARCHAR) AS id, round(sum(g), 8) AS gradient, round(sum(h), 8) AS curvature FROM (SELECT winner AS id, u AS g, u * (1 - u) AS h FROM u UNION ALL SELECT loser, -u, u * (1 - u) FROM u) GROUP BY id""")
def m05_rank_gradients(t: Tables):
    """What a round of boosting fits its tree to, at scores that are a component of the vectors."""
    rows = scratch(_worth(t), "worth")
    raw = rows.select(F.col("id").cast("string").alias("id"), F.get("vector", F.lit(2)).alias("raw"))
    pairs = ranking.ranked_pairs(_duels(t, rows), rows.select(F.col("id").cast("string").alias("id"), "vector"))
    return ranking.lambdas(pairs, raw).select("id", F.round("gradient", 8).alias("gradient"), F.round("curvature", 8).alias("curvature"))


@query()
def m05_m21_boosted_rank(t: Tables):
    """All vectors ranked by boosted trees, and calibrated to their worth."""
    rows = scratch(_worth(t), "worth")
    v = rows.select(F.col("id").cast("string").alias("id"), "vector")
    model = ranking.fit_rank(_duels(t, rows), v, training.Setting(max_iter=5, max_depth=4, step_size=0.5))
    return ranking.calibrated_ranks(ranking.rank_scores(model, v), rows.select(F.col("id").cast("string").alias("id"), F.col("worth").alias("score")))


@query()
def m06_feature_gains(t: Tables):
    from ..operators.vectors import kept_by_gain

    model = training.fit(_rows(t), "regression", training.Setting(max_iter=5, max_depth=3))
    return kept_by_gain(t.spark.createDataFrame(training.gains(model, 64), "feature int, gain double"))


@query("SELECT event_id, event_type FROM events")
def x01_x02_stream_ingest(t: Tables):
    s = ingest.new_names(ingest.file_stream(t.spark, f"{t.dir}/events.parquet", t.events.schema), "event_id")
    return keyed.stream_to_table(s.select("event_id", "event_type"), _checkpoint(t), mode="append").drop("batch")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def x11_windowed_counts(t: Tables):
    s = ingest.windowed_counts(ingest.file_stream(t.spark, f"{t.dir}/events.parquet", t.events.schema))
    return keyed.latest(keyed.stream_to_table(s, _checkpoint(t)), "start", "event_type")


def _checkpoint(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
