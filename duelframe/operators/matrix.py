"""Co-occurrence of parameters and the scores of their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parameters(records: DataFrame, columns: list[str], id_col: str = "id", score: str = "score") -> DataFrame:
    """(id, score, params): "name:value" strings, sorted, without nulls and empty values."""
    items = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c.lower()}:"), F.lower(F.col(c).cast("string")))) for c in columns]
    return records.select(id_col, score, F.array_sort(F.array_distinct(F.array_compact(F.array(*items)))).alias("params"))


def cells(params: DataFrame, score: str = "score") -> DataFrame:
    """(p1, p2, score), p1 <= p2: every pair of one record's parameters, each with itself too.

    The pairs are made inside the record's own array, so there is no join; the record's parameters bound them.
    """
    pairs = F.flatten(F.transform("params", lambda a, i: F.transform(F.slice("params", i + 1, F.size("params") - i), lambda b: F.struct(a.alias("p1"), b.alias("p2")))))
    return params.select(score, F.explode(pairs).alias("p")).select("p.p1", "p.p2", score)


def cell_stats(cells_: DataFrame, least: int = 100, score: str = "score") -> DataFrame:
    """Statistics of the cells with at least `least` scores; quartiles interpolate, std is the sample's, cv is 99.9 for a mean of 0."""
    g = cells_.groupBy("p1", "p2").agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"),
        F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.mode(score, True).alias("mode"),
    )
    g = g.where(F.col("n") >= least).withColumns({"q1": F.col("q")[0], "median": F.col("q")[1], "q3": F.col("q")[2]}).drop("q")
    return g.withColumns({"iqr": F.col("q3") - F.col("q1"), "cv": F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(99.9), "range": F.col("max") - F.col("min")})


def matrix_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("cells"), F.sum("n").alias("entries"), F.avg("mean").alias("mean_of_means"))


def dimensions(params: DataFrame) -> DataFrame:
    """Number of different parameters."""
    return params.select(F.explode("params").alias("p")).agg(F.count_distinct("p").alias("size"))


def top_cells(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("mean"), "p1", "p2").limit(n)


def mirrored(stats: DataFrame) -> DataFrame:
    """Both triangles; nothing in the engine needs it."""
    swapped = stats.where("p1 <> p2").withColumns({"p1": F.col("p2"), "p2": F.col("p1")})
    return stats.unionByName(swapped)


def term_stats(terms: DataFrame) -> DataFrame:
    """(term, mean, std, n, max, min) from (term, weight, score, negative): score * weight, or score * (1 - weight) if negative."""
    v = F.when(F.col("negative"), F.col("score") * (1 - F.col("weight"))).otherwise(F.col("score") * F.col("weight"))
    return terms.withColumn("v", v).groupBy("term").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"), F.max("v").alias("max"), F.min("v").alias("min"))


def extremes(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n highest and the n lowest rows, marked by side."""
    top = df.orderBy(F.desc(by), tie).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(df.orderBy(by, tie).limit(n).withColumn("side", F.lit("bottom")))
