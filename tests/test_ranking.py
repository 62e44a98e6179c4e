"""Boosted ranking: gradients by hand, and an interaction that a linear model cannot rank."""

import math
import random

import pytest
from pyspark.sql import functions as F

from duelframe.operators import ranking, training


def test_gradients_by_hand(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 1.0), (2, "b", "c", 0.5), (3, "a", "b", 2.0)], "pair long, winner string, loser string, weight double")
    scores = {"a": 0.5, "b": -0.25, "c": 900.0}
    got = {r.id: r for r in ranking.lambdas(pairs, spark.createDataFrame(list(scores.items()), "id string, raw double")).collect()}
    g, h = dict.fromkeys(scores, 0.0), dict.fromkeys(scores, 0.0)
    for _, w, lo, x in [tuple(r) for r in pairs.collect()]:
        u = 1 / (1 + math.exp(min(700, scores[w] - scores[lo])))
        g[w], g[lo], h[w], h[lo] = g[w] + x * u, g[lo] - x * u, h[w] + x * u * (1 - u), h[lo] + x * u * (1 - u)
    for k in scores:
        assert got[k].gradient == pytest.approx(g[k]) and got[k].curvature == pytest.approx(h[k], abs=1e-12)
    loss, right = ranking.pair_loss(pairs, spark.createDataFrame(list(scores.items()), "id string, raw double"))
    assert loss == pytest.approx((3 * math.log1p(math.exp(-0.75)) + 0.5 * 900.25) / 3.5) and right == pytest.approx(3 / 3.5)
    assert ranking.pair_loss(pairs.where("false"), spark.createDataFrame([("a", 0.0)], "id string, raw double")) == (None, None)


def test_trees_rank_an_interaction(spark):
    rng = random.Random(8)
    x = {f"i{k:03d}": [rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1)] for k in range(300)}
    worth = {k: v[0] * v[1] for k, v in x.items()}
    rows = []
    for i in range(3000):
        a, b = rng.sample(sorted(x), 2)
        rows.append((i, a, b, a if worth[a] > worth[b] else b, 1.0))
    rows += [(9000, "i000", "nobody", "i000", 1.0), (9001, "i000", "i000", "i000", 1.0), (9002, "i000", "i001", "other", 1.0)]
    c = spark.createDataFrame(rows, "id long, filename_a string, filename_b string, winner string, weight double")
    v = spark.createDataFrame([*x.items(), ("none", None)], "id string, vector array<double>")
    model = ranking.fit_rank(c, v, training.Setting(max_iter=8, max_depth=4, step_size=0.5))
    raw = ranking.rank_scores(model, v)
    pairs = ranking.ranked_pairs(c, v)
    assert pairs.count() == 3000 and raw.count() == 300
    accuracy = ranking.pair_loss(pairs, raw)[1]
    linear = training.fit(training.differences(c, v.where("vector is not null")).withColumnRenamed("features", "vector"), "rank", label="label")
    plain = training.predict(linear, v.where("vector is not null"), "rank").select("id", F.col("prediction").alias("raw"))
    assert accuracy > 0.8 > 0.6 > ranking.pair_loss(pairs, plain)[1]
    assert [k for k, *_ in model.curve] == list(range(1, len(model.curve) + 1)) and model.curve[0][2] > min(e for *_, e in model.curve)
    gains = dict(model.gains(3))
    assert gains[0] > gains[2] and gains[1] > gains[2]
    scores = spark.createDataFrame([(k, s) for k, s in worth.items()], "id string, score double")
    done = ranking.calibrated_ranks(raw, scores).agg(F.min("calibrated"), F.max("calibrated"), F.corr("raw", "calibrated")).first()
    assert done[0] == pytest.approx(min(worth.values()), abs=1e-5) and done[1] == pytest.approx(max(worth.values()), abs=1e-5) and done[2] > 0.8
    with pytest.raises(ValueError, match="no score"):
        ranking.calibrated_ranks(raw, scores.where("id <> 'i007'"))


def test_boosting_stops_early(spark):
    """Winners by chance: the held-out loss soon rises, and trees after its best round are dropped."""
    rng = random.Random(3)
    x = {f"i{k:03d}": [rng.random(), rng.random()] for k in range(60)}
    rows = [(i, *(p := rng.sample(sorted(x), 2)), rng.choice(p), 1.0) for i in range(300)]
    c = spark.createDataFrame(rows, "id long, filename_a string, filename_b string, winner string, weight double")
    model = ranking.fit_rank(c, spark.createDataFrame(list(x.items()), "id string, vector array<double>"), training.Setting(max_iter=12, max_depth=5, step_size=0.9), patience=2)
    losses = [e for *_, e in model.curve]
    assert len(model.curve) < 12 and len(model.trees) == losses.index(min(losses)) + 1 == len(losses) - 2
