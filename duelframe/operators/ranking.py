"""Learning to rank from comparisons with boosted trees.

A comparison is a group of two. Each round turns the scores so far into a gradient and a curvature for every image, summed over all its
comparisons, and fits one regression tree to them: with gradient / curvature as the target and the curvature as the weight, a leaf's mean is
its Newton step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TRAINING
from ..scratch import scratch
from . import calibration
from .tables import valid_winner, with_loser
from .training import Setting, as_vector, split


@dataclass(frozen=True)
class RankModel:
    """The trees in order, the share of each that counts, and (round, loss, loss on held-out pairs) of all rounds."""

    trees: tuple
    step_size: float
    curve: tuple[tuple[int, float, float | None], ...]

    def gains(self, size: int) -> list[tuple[int, float]]:
        """(feature, importance), summed over the trees."""
        total = [0.0] * size
        for t in self.trees:
            for i in range(size):
                total[i] += float(t.featureImportances[i])
        return list(enumerate(total))


def ranked_pairs(comparisons: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pair, winner, loser, weight) of the comparisons whose two images are different and have a vector each."""
    c = with_loser(valid_winner(comparisons)).where("winner <> loser").select(F.col("id").alias("pair"), "winner", "loser", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    known = vectors.where("vector is not null").select("id").distinct()
    return c.join(known.withColumnRenamed("id", "winner"), "winner", "left_semi").join(known.withColumnRenamed("id", "loser"), "loser", "left_semi").select("pair", "winner", "loser", "weight")


def upset(margin: Column) -> Column:
    """The probability 1 / (1 + e^margin) that the one behind wins, for margins of any size."""
    small = F.exp(-F.abs(margin))
    return F.when(margin > 0, small).otherwise(1.0) / (1 + small)


def margins(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """pairs with margin: the winner's score less the loser's."""
    w, lo = scores.select(F.col("id").alias("winner"), F.col("raw").alias("_w")), scores.select(F.col("id").alias("loser"), F.col("raw").alias("_l"))
    return pairs.join(w, "winner").join(lo, "loser").select(*pairs.columns, (F.col("_w") - F.col("_l")).alias("margin"))


def lambdas(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, gradient, curvature) of every image in the pairs, from scores (id, raw).

    In a group of two, exchanging both changes the gain by a constant, so the weights of ranks drop out. Each pair gives two rows, which
    combine before the exchange; an image in very many comparisons is a sum like others.
    """
    p = margins(pairs, scores).withColumn("u", upset(F.col("margin")))
    step, bend = F.col("weight") * F.col("u"), F.col("weight") * F.col("u") * (1 - F.col("u"))
    two = F.explode(F.array(F.struct(F.col("winner").alias("id"), step.alias("g"), bend.alias("h")), F.struct(F.col("loser").alias("id"), (-step).alias("g"), bend.alias("h"))))
    return p.select(two.alias("r")).groupBy(F.col("r.id").alias("id")).agg(F.sum("r.g").alias("gradient"), F.sum("r.h").alias("curvature"))


def pair_loss(pairs: DataFrame, scores: DataFrame) -> tuple[float | None, float | None]:
    """(mean log loss, share of pairs in the right order, ties half), by weight; None twice without pairs."""
    p = margins(pairs, scores)
    loss = F.log1p(F.exp(-F.abs("margin"))) + F.greatest(-F.col("margin"), F.lit(0.0))
    right = F.when(F.col("margin") > 0, 1.0).when(F.col("margin") == 0, 0.5).otherwise(0.0)
    r = p.agg(F.sum(loss * F.col("weight")), F.sum(right * F.col("weight")), F.sum("weight")).first()
    return (r[0] / r[2], r[1] / r[2]) if r[2] else (None, None)


def fit_rank(comparisons: DataFrame, vectors: DataFrame, setting: Setting | None = None, patience: int = 5, test: float = 0.2) -> RankModel:
    """A ranking model of vectors (id, vector) from comparisons (id, filename_a, filename_b, winner, weight).

    A share `test` of the pairs, by the split's digest, is held out; boosting ends after setting.max_iter rounds, or when their loss has not
    fallen for `patience` rounds, and keeps the trees up to the best round. Scores are written each round, so that a round reads the pairs,
    the vectors and the scores before it, and nothing of earlier rounds.
    """
    from pyspark.ml.regression import DecisionTreeRegressor

    s = setting or Setting()
    pairs = split(ranked_pairs(comparisons, vectors), "pair", test)
    pairs = scratch(pairs, "pairs")
    learn, held = pairs.where("not is_test"), pairs.where("is_test")
    rows = scratch(as_vector(vectors.where("vector is not null")).select("id", "features"), "features")
    scores = scratch(rows.select("id", F.lit(0.0).alias("raw")), "raw")
    tree = DecisionTreeRegressor(labelCol="target", weightCol="curvature", featuresCol="features", maxDepth=s.max_depth, maxBins=s.max_bins, seed=TRAINING.random_state, predictionCol="step")
    trees, curve, best, kept = [], [], None, 0
    for k in range(1, s.max_iter + 1):
        now = lambdas(learn, scores).where("curvature > 0").withColumn("target", F.col("gradient") / F.col("curvature"))
        model = tree.fit(scratch(rows.join(now, "id"), "gradients"))
        trees.append(model)
        scores = scratch(model.transform(rows).select("id", "step").join(scores, "id").select("id", (F.col("raw") + s.step_size * F.col("step")).alias("raw")), "raw")
        own, (other, _) = pair_loss(learn, scores)[0], pair_loss(held, scores)
        curve.append((k, own, other))
        judged = own if other is None else other
        if best is None or judged < best - 1e-9:
            best, kept = judged, k
        elif k - kept >= patience:
            break
    return RankModel(tuple(trees[:kept]), s.step_size, tuple(curve))


def rank_scores(model: RankModel, vectors: DataFrame) -> DataFrame:
    """(id, raw): the weighted sum of the trees, for every row with a vector."""
    out = as_vector(vectors.where("vector is not null")).select("id", "features")
    for k, t in enumerate(model.trees):
        out = t.copy().setPredictionCol(f"_t{k}").transform(out)
    total = F.lit(0.0)
    for k in range(len(model.trees)):
        total = total + F.lit(model.step_size) * F.col(f"_t{k}")
    return out.select("id", total.alias("raw"))


def calibrated_ranks(raw: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, raw, calibrated): quantiles of raw matched to those of scores (id, score); every row of raw needs a score."""
    j = scratch(raw.join(scores.select("id", "score"), "id", "left"), "ranked")
    if j.where("score is null").limit(1).count():
        raise ValueError("a ranked row has no score to calibrate with")
    return j.select("id", "raw", calibration.apply(F.col("raw"), calibration.build(j, "raw", "score")).alias("calibrated"))
