"""Training sets, score models, selection of what to score, and the search over model settings."""

from __future__ import annotations

import random
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TRAINING
from . import calibration
from .tables import valid_winner, with_loser


def split(df: DataFrame, id_col: str = "id", test: float = 0.2, seed: int = TRAINING.random_state) -> DataFrame:
    """df with is_test: by the first 32 bits of a digest of id and seed, so a row is on the same side in every run, partitioning and engine."""
    return df.withColumn("is_test", F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), 1, 8) < f"{int(test * (1 << 32)):08x}")


def pairwise(comparisons: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pair, filename, vector, label, weight): two rows for each comparison whose images both have a vector."""
    c = with_loser(valid_winner(comparisons)).where("winner <> loser")
    v = vectors.select(F.col("id").alias("filename"), "vector")
    w, lo = v.withColumnsRenamed({"filename": "winner", "vector": "wv"}), v.withColumnsRenamed({"filename": "loser", "vector": "lv"})
    j = c.join(w, "winner").join(lo, "loser")
    two = F.explode(F.array(F.struct(F.col("winner").alias("filename"), F.col("wv").alias("vector"), F.lit(1).alias("label")), F.struct(F.col("loser").alias("filename"), F.col("lv").alias("vector"), F.lit(0).alias("label"))))
    return j.select(F.col("id").alias("pair"), two.alias("r"), F.coalesce("weight", F.lit(1.0)).alias("weight")).select("pair", "r.*", "weight")


def differences(comparisons: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pair, features, label, weight): winner minus loser with label 1, and the reverse with label 0."""
    c = with_loser(valid_winner(comparisons)).where("winner <> loser")
    v = vectors.select("id", "vector")
    j = c.select(F.col("id").alias("pair"), "winner", "loser", "weight").join(v.select(F.col("id").alias("winner"), F.col("vector").alias("wv")), "winner").join(v.select(F.col("id").alias("loser"), F.col("vector").alias("lv")), "loser")
    d = F.zip_with("wv", "lv", lambda a, b: a.cast("double") - b.cast("double"))
    two = F.explode(F.array(F.struct(d.alias("features"), F.lit(1.0).alias("label")), F.struct(F.transform(d, lambda x: -x).alias("features"), F.lit(0.0).alias("label"))))
    return j.select("pair", F.coalesce("weight", F.lit(1.0)).alias("weight"), two.alias("r")).select("pair", "r.*", "weight")


@dataclass(frozen=True)
class Setting:
    """One configuration of a tree model."""

    max_iter: int = 20
    max_depth: int = 5
    step_size: float = 0.1
    max_bins: int = 32
    score: float = -1e6
    seconds: float = 0.0

    def key(self) -> tuple:
        return self.max_iter, self.max_depth, self.step_size, self.max_bins


#: The values that the search steps through.
GRID = {"max_iter": (5, 10, 20, 40, 80), "max_depth": (2, 3, 4, 5, 6, 8), "step_size": (0.02, 0.05, 0.1, 0.2, 0.3), "max_bins": (16, 32, 64, 128)}


def as_vector(df: DataFrame, c: str = "vector") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.transform(c, lambda x: x.cast("double"))))


def fit(df: DataFrame, objective: str = "regression", setting: Setting | None = None, label: str = "score", validation: str | None = None):
    """A fitted model of `label` on the array column vector.

    objective: regression and binary boost trees (with early stopping on the validation column), multiclass
    grows a forest, rank fits a logistic model on pair differences (see differences).
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor

    s = setting or Setting()
    tree = {"labelCol": label, "featuresCol": "features", "seed": TRAINING.random_state, "maxDepth": s.max_depth, "maxBins": s.max_bins}
    if objective in ("regression", "binary"):
        kind = GBTRegressor if objective == "regression" else GBTClassifier
        model = kind(**tree, maxIter=s.max_iter, stepSize=s.step_size)
        if validation:
            model = model.setValidationIndicatorCol(validation)
    elif objective == "multiclass":
        model = RandomForestClassifier(**tree, numTrees=s.max_iter)
    elif objective == "rank":
        model = LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", fitIntercept=False, regParam=1e-3)
    else:
        raise ValueError(f"unknown objective: {objective}")
    return model.fit(as_vector(df))


def predict(model, df: DataFrame, objective: str = "regression") -> DataFrame:
    """df with prediction: the value, the probability of class 1, the scaled mean class, or the rank score."""
    from pyspark.ml.functions import vector_to_array

    from .stats import min_max
    from .vectors import expected_class

    if objective == "rank":
        w = F.array(*[F.lit(float(x)) for x in model.coefficients])
        raw = F.aggregate(F.zip_with(w, "vector", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return min_max(df.withColumn("raw", raw), "raw", "prediction")
    out = model.transform(as_vector(df))
    if objective == "binary":
        out = out.withColumn("prediction", vector_to_array("probability")[1])
    elif objective == "multiclass":
        out = out.withColumn("prediction", expected_class(vector_to_array("probability")))
    return out.select(*df.columns, "prediction")


def gains(model, size: int) -> list[tuple[int, float]]:
    """(feature, importance)."""
    v = model.featureImportances
    return [(i, float(v[i])) for i in range(size)]


def calibrated(df: DataFrame, raw: str = "prediction", target: str = "score") -> DataFrame:
    return df.withColumn("calibrated", calibration.apply(F.col(raw), calibration.build(df, raw, target)))


def end_to_end(entries: DataFrame, vectors: DataFrame, scores: DataFrame, threshold: float, least: int = 0, most: int | None = None, setting: Setting | None = None) -> DataFrame:
    """(id, prediction, calibrated) of the entries worth taking: a model fitted on the scored vectors, applied to all, calibrated, selected.

    A fifth of the scored rows, by the split's digest, stops the boosting early. Entries without a vector are left out.
    """
    from .vectors import with_scores

    known = split(with_scores(vectors, scores))
    model = fit(known, "regression", setting, validation="is_test")
    table = calibration.build(predict(model, known), "prediction", "score")
    found = predict(model, entries.select("id").distinct().join(vectors, "id"))
    return select_scored(found.select("id", "prediction", calibration.apply(F.col("prediction"), table).alias("calibrated")), threshold, least, most, "calibrated")


def curve(model) -> list[tuple[int, float]]:
    """(trees, root mean squared error on the rows the model is evaluated on) is what evaluateEachIteration gives; finite values only."""
    return [(i + 1, float(v)) for i, v in enumerate(model) if v == v and abs(v) != float("inf")]


def select_scored(df: DataFrame, threshold: float, least: int = 0, most: int | None = None, score: str = "prediction", tie: str = "id") -> DataFrame:
    """The rows at or above the threshold, but at least the best `least` and at most the best `most`."""
    if not 0 <= least <= (most if most is not None else least):
        raise ValueError("0 <= least <= most is needed")
    above = df.where(F.col(score) >= threshold)
    if least:
        above = above.unionByName(df.orderBy(F.desc(score), tie).limit(least)).dropDuplicates([tie])
    return above if most is None else above.orderBy(F.desc(score), tie).limit(most)


def neighbours(s: Setting) -> list[Setting]:
    """Settings that differ from s by one step in one value."""
    out = []
    for name, values in GRID.items():
        at = min(range(len(values)), key=lambda i: abs(values[i] - getattr(s, name)))
        for i in (at - 1, at + 1):
            if 0 <= i < len(values):
                out.append(Setting(**{n: values[i] if n == name else getattr(s, n) for n in GRID}))
    return out


def random_setting(rng: random.Random) -> Setting:
    return Setting(**{n: rng.choice(v) for n, v in GRID.items()})


def fastest() -> Setting:
    return Setting(GRID["max_iter"][0], GRID["max_depth"][0], GRID["step_size"][-1], GRID["max_bins"][0])


def slowest() -> Setting:
    return Setting(GRID["max_iter"][-1], GRID["max_depth"][-1], GRID["step_size"][0], GRID["max_bins"][-1])


def crossover(a: Setting, b: Setting, rng: random.Random) -> Setting:
    return Setting(**{n: getattr(rng.choice((a, b)), n) for n in GRID})


@dataclass
class Search:
    """An evolutionary search: five settings take turns to try neighbours, the best two breed."""

    evaluate: object
    rng: random.Random = field(default_factory=lambda: random.Random(TRAINING.random_state))
    top: list[Setting] = field(default_factory=list)
    used: dict[tuple, Setting] = field(default_factory=dict)

    def reset(self) -> None:
        self.top = [*(random_setting(self.rng) for _ in range(3)), slowest(), fastest()]

    def scored(self, s: Setting) -> Setting:
        if s.key() not in self.used:
            begin = time.perf_counter()
            value = self.evaluate(s)
            self.used[s.key()] = Setting(*s.key(), score=value, seconds=time.perf_counter() - begin)
        return self.used[s.key()]

    def step(self, i: int, most: int = 2) -> Setting:
        """The better of top[i] and up to `most` unused neighbours."""
        best = self.scored(self.top[i])
        for n in [n for n in neighbours(best) if n.key() not in self.used][:most]:
            best = max(best, self.scored(n), key=lambda s: s.score)
        self.top[i] = best
        return best

    def cycle(self, most: int = 2) -> Setting:
        if not self.top:
            self.reset()
        for i in range(len(self.top)):
            self.step(i, most)
        self.top.sort(key=lambda s: -s.score)
        a, b = self.top[:2]
        self.top = [a, b, crossover(a, b, self.rng), crossover(b, a, self.rng), random_setting(self.rng)]
        return a

    def run(self, cycles: int, most: int = 2) -> Setting:
        return max((self.cycle(most) for _ in range(cycles)), key=lambda s: s.score)
