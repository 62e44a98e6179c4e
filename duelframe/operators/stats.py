"""Counts, histograms, correlations and rank tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RANKING
from ..functions.rating_math import normal_cdf
from .history import sides
from .tables import with_loser


def finite(c: str) -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def comparison_counts(comparisons: DataFrame) -> DataFrame:
    """(filename, n): comparisons on either side."""
    return sides(comparisons).groupBy("filename").agg(F.count("*").alias("n"))


def degree_filter(comparisons: DataFrame, least: int) -> DataFrame:
    """Comparisons whose two images both have at least `least` comparisons; one pass, not repeated."""
    ok = comparison_counts(comparisons).where(F.col("n") >= least).select("filename")
    a = comparisons.join(ok.withColumnRenamed("filename", "filename_a"), "filename_a", "left_semi")
    return a.join(ok.withColumnRenamed("filename", "filename_b"), "filename_b", "left_semi").select(*comparisons.columns)


def summary(df: DataFrame, c: str = "score") -> DataFrame:
    return df.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"))


def histogram(df: DataFrame, c: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) of equal width between the extremes; the last bin has the maximum, one value makes one bin."""
    x = F.col(c).cast("double")
    ends = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"))
    step = (F.col("mx") - F.col("mn")) / bins
    k = F.when(F.col("mx") == F.col("mn"), 0).otherwise(F.least(F.floor((x - F.col("mn")) / step), F.lit(bins - 1))).cast("int")
    out = df.where(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(k.alias("bin"), "mn", "mx").agg(F.count("*").alias("n"))
    return out.select("bin", (F.col("mn") + F.col("bin") * step).alias("low"), F.when(F.col("mx") == F.col("mn"), F.col("mx")).otherwise(F.col("mn") + (F.col("bin") + 1) * step).alias("high"), "n")


def threshold_buckets(df: DataFrame, c: str, limits: list[float]) -> DataFrame:
    """(bucket, n): bucket i has the values under limits[i] and not under the one before; the last has the rest."""
    b = F.lit(len(limits))
    for i in reversed(range(len(limits))):
        b = F.when(F.col(c) < limits[i], i).otherwise(b)
    return df.where(F.col(c).isNotNull()).groupBy(b.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def status(images: DataFrame) -> DataFrame:
    n = F.col("comparison_count")
    return images.agg(F.count_if(n > 0).alias("ranked"), F.count_if(n == 0).alias("unranked"), F.count("*").alias("total"))


def level_progress(images: DataFrame) -> DataFrame:
    """The smallest comparison count, and how many images are at it and at the next level."""
    low = images.agg(F.min("comparison_count").alias("level"))
    n = F.col("comparison_count")
    return images.crossJoin(F.broadcast(low)).groupBy("level").agg(F.count_if(n == F.col("level")).alias("at_level"), F.count_if(n == F.col("level") + 1).alias("at_next"))


def levels(images: DataFrame) -> DataFrame:
    return images.groupBy("comparison_count").agg(F.count("*").alias("n"))


def readiness(images: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row: images above and below the uncertainty limit, with one win, with one loss, at the seed target."""
    c = with_loser(comparisons).where("winner <> loser")
    wins = c.groupBy(F.col("winner").alias("filename")).agg(F.count_distinct("loser").alias("wins"))
    losses = c.groupBy(F.col("loser").alias("filename")).agg(F.count_distinct("winner").alias("losses"))
    j = images.join(wins, "filename", "left").join(losses, "filename", "left")
    return j.agg(
        F.count_if(F.col("rating_sigma") >= RANKING.sigma_threshold).alias("sigma_above"), F.count_if(F.col("rating_sigma") < RANKING.sigma_threshold).alias("sigma_below"),
        F.count_if(F.col("wins") == 1).alias("single_win"), F.count_if(F.col("losses") == 1).alias("single_loss"), F.count_if(F.col("comparison_count") >= RANKING.seed_target).alias("ready"),
    )


def category_stats(records: DataFrame, key: str, score: str = "score") -> DataFrame:
    return records.where(F.col(key).isNotNull() & (F.col(key) != "unknown")).groupBy(key).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count("*").alias("n"))


def global_stats(df: DataFrame, score: str = "score") -> DataFrame:
    return df.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(finite(x) & finite(y)).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def correlation_scores(df: DataFrame, features: list[str], y: str, top: int | None = None) -> DataFrame:
    """(feature, idx, n, r, f): Pearson r with y from streamed sums, and its F score; `top` best in index order.

    All features' sums come from one aggregation; a constant feature has r = 0.
    """
    n, sy, syy = F.count("*"), F.sum(y), F.sum(F.col(y) * F.col(y))
    sums = [n.alias("n"), sy.alias("sy"), syy.alias("syy")]
    for i, c in enumerate(features):
        sums += [F.sum(c).alias(f"sx{i}"), F.sum(F.col(c) * F.col(c)).alias(f"sxx{i}"), F.sum(F.col(c) * F.col(y)).alias(f"sxy{i}")]
    one = df.agg(*sums)
    item = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("idx"), F.col(f"sx{i}").alias("sx"), F.col(f"sxx{i}").alias("sxx"), F.col(f"sxy{i}").alias("sxy")) for i, c in enumerate(features)]))
    t = one.select("n", "sy", "syy", item.alias("t")).select("n", "sy", "syy", "t.*")
    cov, vx, vy = F.expr("n * sxy - sx * sy"), F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    r = F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy)).otherwise(0.0)
    t = t.select("feature", "idx", "n", r.alias("r"))
    t = t.withColumn("f", F.col("r") * F.col("r") * (F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-12)))
    if top is not None:
        t = t.orderBy(F.desc("f"), "idx").limit(top).orderBy("idx")
    return t


def usage_filtered(df: DataFrame, key: str, score: str, part: float = 0.1, limit: int = 10) -> DataFrame:
    """The most used `part` of the keys (one at least), by mean score: (key, n, mean, std)."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"))
    keep = max(1, int(g.count() * part))
    return g.orderBy(F.desc("n"), key).limit(keep).orderBy(F.desc("mean"), key).limit(limit)


def binned(df: DataFrame, x: str, y: str, bins: int = 10, exact: bool = False) -> DataFrame:
    """(bin, x_low, mean, std, n) of y in at most `bins` equal ranges of x; with exact, (x, mean, std, n) for each value, if there are at most `bins`."""
    kept = df.where(finite(x) & finite(y))
    if exact and len(kept.select(x).distinct().limit(bins + 1).collect()) <= bins:
        return kept.groupBy(x).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.count("*").alias("n"))
    ends = df.where(finite(x) & finite(y)).agg(F.min(x).alias("mn"), F.max(x).alias("mx"))
    k = F.when(F.col("mx") == F.col("mn"), 0).otherwise(F.least(F.floor((F.col(x) - F.col("mn")) * bins / (F.col("mx") - F.col("mn"))), F.lit(bins - 1))).cast("int")
    g = df.where(finite(x) & finite(y)).crossJoin(F.broadcast(ends)).groupBy(k.alias("bin")).agg(F.min(x).alias("x_low"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.count("*").alias("n"))
    return g


def duplicate_points(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(x, y).agg(F.count("*").alias("n"))


def min_max(df: DataFrame, c: str, name: str = "scaled") -> DataFrame:
    """c scaled to 0 .. 1 by the table's extremes; a constant becomes 0.5."""
    ends = df.agg(F.min(c).alias("_mn"), F.max(c).alias("_mx"))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.when(F.col("_mx") > F.col("_mn"), (F.col(c) - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))).otherwise(0.5)).drop("_mn", "_mx")


def cumulative(df: DataFrame, x: str, n: str, name: str = "upto", cuts: int = 255) -> DataFrame:
    """df with the running sum of n in the order of x (numbers, each once), without putting all rows into one task.

    Approximate quantiles cut the values into ranges; sums within a range come from a window over the range, and
    those of the ranges before from at most cuts + 1 sums.
    """
    points = df.agg(F.percentile_approx(x, F.array(*[F.lit(i / (cuts + 1)) for i in range(1, cuts + 1)]), 10_000)).first()[0] or []
    place = F.size(F.filter(F.array(*[F.lit(float(p)) for p in points]), lambda p: p < F.col(x))) if points else F.lit(0)
    ranged = df.withColumn("_range", place)
    sums = {r[0]: r[1] for r in ranged.groupBy("_range").agg(F.sum(n)).collect()}
    before, total = [], 0
    for k in range(len(points) + 1):
        before.append(total)
        total += sums.get(k, 0)
    own = F.sum(n).over(W.partitionBy("_range").orderBy(x).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(name, own + F.get(F.array(*[F.lit(b) for b in before]), F.col("_range"))).drop("_range")


def rank_sum(df: DataFrame, group: str, x: str) -> DataFrame:
    """Mann-Whitney U of x between group = true and false, its z by the tie-corrected normal approximation, and the two-sided p-value.

    p comes from z moved half a rank towards 0; null where all values are equal or a group is empty.
    Ranks come from counts by value, cumulated over the values; ties get their mean rank.
    """
    v = df.where(finite(x) & F.col(group).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count_if(F.col(group)).alias("a"), F.count("*").alias("t"))
    v = cumulative(v, "x", "t").withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2.0)
    s = v.agg(F.sum(F.col("a") * F.col("rank")).alias("ra"), F.sum("a").alias("na"), F.sum("t").alias("n"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    s = s.withColumn("nb", F.col("n") - F.col("na")).withColumn("u", F.expr("ra - na * (na + 1) / 2.0"))
    sd = F.sqrt(F.expr("na * nb / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))"))
    off = F.col("u") - F.expr("na * nb / 2.0")
    sd = F.when(sd > 0, sd)
    return s.select("na", "nb", "u", (off / sd).alias("z"), F.least(2 * normal_cdf((0.5 - F.abs(off)) / sd), F.lit(1.0)).alias("p"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    m = df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("v"))
    return m.select("mae", "rmse", (1 - F.col("mse") / F.col("v")).alias("r2"))


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy, and macro precision, recall and F1, macro and weighted, from one confusion table."""
    c = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    cls = F.explode(F.array(F.struct(F.col("y").alias("k"), F.col("n").alias("s"), F.lit(0).alias("q")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("s"), F.lit(1).alias("q"))))
    e = c.withColumn("c", cls)
    g = e.groupBy("c.k").agg(F.sum(F.when((F.col("y") == F.col("p")) & (F.col("c.q") == 0), F.col("n")).otherwise(0)).alias("tp"), F.sum("c.s").alias("support"), F.sum(F.when(F.col("c.q") == 1, F.col("n")).otherwise(0)).alias("predicted"))
    g = g.withColumns({"precision": F.expr("if(predicted > 0, tp / predicted, 0.0)"), "recall": F.expr("if(support > 0, tp / support, 0.0)")})
    g = g.withColumn("f1", F.expr("if(precision + recall > 0, 2 * precision * recall / (precision + recall), 0.0)"))
    return g.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    return df.agg((-F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"))


def pairwise_accuracy(comparisons: DataFrame, scores: DataFrame) -> DataFrame:
    """Part of the comparisons whose winner has the higher score (ties count half)."""
    c = with_loser(comparisons).where("winner <> loser")
    w, lo = scores.select(F.col("filename").alias("winner"), F.col("score").alias("ws")), scores.select(F.col("filename").alias("loser"), F.col("score").alias("ls"))
    return c.join(w, "winner").join(lo, "loser").agg(F.avg(F.when(F.col("ws") > F.col("ls"), 1.0).when(F.col("ws") == F.col("ls"), 0.5).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n"))
