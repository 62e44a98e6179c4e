"""Derived tables: what a change rebuilds, and models that predict the same once loaded."""

import pytest
from pyspark.sql import functions as F

from duelframe.operators import derived


def build(store, a, b, scale=2):
    store.table("sums", {"rows": a}, lambda rows, scale: rows.groupBy("k").agg((F.sum("v") * scale).alias("s")), {"scale": scale})
    store.table("names", {"rows": b}, lambda rows: rows.select("k", F.upper("name").alias("name")))
    store.table("both", {"s": "sums", "n": "names"}, lambda s, n: s.join(n, "k"))
    return store.table("top", {"x": "both"}, lambda x: x.orderBy(F.desc("s")).limit(1))


def test_a_change_rebuilds_its_dependants_alone(spark, tmp_path):
    a = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k int, v double")
    b = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "k int, name string")
    folder = f"file://{tmp_path}/store"

    def names(*given, **kw):
        store = derived.Store(spark, folder)
        row = build(store, *given, **kw).first()
        return store.built, row.name

    assert names(a, b) == (["sums", "names", "both", "top"], "Z")
    assert names(a.repartition(5), b.orderBy(F.desc("k"))) == ([], "Z")  # the same rows in another order
    assert names(a, b.withColumn("name", F.concat("name", F.lit("!")))) == (["names", "both", "top"], "Z!")
    assert names(a, b) == (["names", "both", "top"], "Z")
    assert names(a, b, scale=3) == (["sums", "both", "top"], "Z")
    assert names(a.union(a.where("false")).withColumn("v", F.col("v") + 0.0), b, scale=3) == ([], "Z")
    more = spark.createDataFrame([(0, 1.0), (0, -1.0)], "k int, v double")
    assert names(a.union(more), b, scale=3) == (["sums"], "Z")  # other rows, the same sums: what depends on them stays
    with pytest.raises(ValueError, match="nothing is derived"):
        derived.Store(spark, folder).fingerprint({"x": "unknown"}, {})


def test_a_loaded_model_predicts_the_same(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df = spark.createDataFrame([(float(i), float(i % 7), float(i % 7) ** 2) for i in range(80)], "a double, b double, y double")

    def fit(rows, trees):
        model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), GBTRegressor(labelCol="y", maxIter=trees, seed=1)]).fit(rows)
        return model, {"rmse": rows.join(model.transform(rows).select("a", "prediction"), "a").agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]}

    first, again = derived.Store(spark, f"file://{tmp_path}/m"), derived.Store(spark, f"file://{tmp_path}/m")
    model, metrics = first.model("score", {"rows": df}, fit, PipelineModel, {"trees": 3})
    loaded, kept = again.model("score", {"rows": df}, fit, PipelineModel, {"trees": 3})
    assert first.built == ["score"] and again.built == [] and kept == metrics and metrics["rmse"] < 3
    assert [r.prediction for r in loaded.transform(df).orderBy("a").collect()] == [r.prediction for r in model.transform(df).orderBy("a").collect()]
    again.model("score", {"rows": df}, fit, PipelineModel, {"trees": 4})
    assert again.built == ["score"]
