"""Which pair of images to compare next.

Candidates are a DataFrame (filename, score, mu, sigma, n): name, public score, rating and comparison count.
Each phase gives one row (a, b, phase) or none; next_pair takes the first phase that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RANKING
from ..functions.rating_math import conservative
from ..scratch import scratch
from . import graph
from .tables import only_losers, only_winners

PHASES = ("seed_coverage", "anchor_insert", "collapsible", "single_win_loss", "chain_merge", "uncertainty", "fallback")


def candidates(images: DataFrame) -> DataFrame:
    return images.select("filename", "score", F.col("rating_mu").alias("mu"), F.col("rating_sigma").alias("sigma"), F.col("comparison_count").alias("n"), conservative(F.col("rating_mu"), F.col("rating_sigma")).alias("skill"))


def seed_pool(cand: DataFrame, total: int) -> DataFrame:
    """The most compared part of the images, one at least."""
    return cand.orderBy(F.desc("n"), "filename").limit(max(1, total * RANKING.seed_percentage // 100))


def _one(df: DataFrame, phase: str) -> DataFrame:
    return df.limit(1).select("a", "b", F.lit(phase).alias("phase"))


def unseen(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """pairs (a, b, ...) that no comparison joins; links is (filename_a, filename_b) in order."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return pairs.join(links, (low == F.col("filename_a")) & (high == F.col("filename_b")), "left_anti")


def _unseen_by(one: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """unseen, written, for pairs that all have the single row of `one` as their first node: only its own links are dealt."""
    name = F.broadcast(one.select("filename"))
    own = links.join(name, (F.col("filename_a") == F.col("filename")) | (F.col("filename_b") == F.col("filename")), "left_semi")
    return scratch(unseen(pairs, own), "near")


def widest_within(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, gap, sigma): the widest gap within reach.

    For pairs that share their first node: the widest gap not above its sigma, or the narrowest if none is; this is what closest_pair
    gives for them, without a bound on their number.
    """
    fits = F.col("gap") <= F.col("sigma")
    return pairs.orderBy(F.desc(fits), F.when(fits, -F.col("gap")).otherwise(F.col("gap")), "a", "b")


def closest_pair(pairs: DataFrame, most: int = 100) -> DataFrame:
    """(a, b) of at most `most` pairs (place, a, b, gap, sigma), by gap and place: the widest gap before the first one that exceeds the deviation of the node chosen so far.

    Each wider pair that comes before that is chosen in turn, so the deviation compared with is that of its first node. The pairs,
    whose number is checked, are one array, folded in place.
    """
    kind = "struct<a: string, b: string, gap: double, sigma: double, open: boolean>"
    rows = F.array_sort(F.collect_list(F.struct("gap", "place", "a", "b", "sigma")))
    one = pairs.agg(F.when(F.count("*") > most, F.raise_error(F.lit(f"more than {most} pairs")).cast("array<struct<gap: double, place: int, a: string, b: string, sigma: double>>")).otherwise(rows).alias("rows")).where("size(rows) > 0")
    first = F.get("rows", F.lit(0))

    def step(at: Column, x: Column) -> Column:
        still = at["open"] & (x["gap"] <= at["sigma"])
        pick = still & (x["gap"] > at["gap"])
        return F.struct(*[F.when(pick, x[c]).otherwise(at[c]).alias(c) for c in ("a", "b", "gap", "sigma")], still.alias("open")).cast(kind)

    start = F.struct(*[first[c].alias(c) for c in ("a", "b", "gap", "sigma")], F.lit(True).alias("open")).cast(kind)
    return one.select(F.aggregate("rows", start, step).alias("x")).select("x.a", "x.b")


def _against(one: DataFrame, others: DataFrame) -> DataFrame:
    """The single row of `one` with every other row: (a, b, gap, sigma, mu_gap, ...)."""
    first = one.select(*[F.col(c).alias(f"{c}_a") for c in one.columns])
    j = others.crossJoin(F.broadcast(first)).where(F.col("filename") != F.col("filename_a"))
    return j.select(
        F.col("filename_a").alias("a"), F.col("filename").alias("b"), F.abs(F.col("skill_a") - F.col("skill")).alias("gap"), F.col("sigma_a").alias("sigma"),
        F.abs(F.col("mu_a") - F.col("mu")).alias("mu_gap"), F.col("n_a"), F.col("n"),
    )


def seed_coverage(cand: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """While too few images are well compared: the most compared image below the target, and its widest admissible partner."""
    size = total * RANKING.seed_percentage // 100
    ready = seed_pool(cand, total).where(F.col("n") >= RANKING.seed_target).count()
    if ready >= size:
        return _none(cand)
    under = cand.where(F.col("n") < RANKING.seed_target).orderBy(F.desc("n"), "filename")
    anchor, rest = under.limit(1), under.offset(1).limit(size - ready)
    return _one(widest_within(unseen(_against(anchor, rest).where("n <= n_a + 2"), links)), "seed_coverage")


def _none(cand: DataFrame) -> DataFrame:
    return cand.limit(0).select(F.col("filename").alias("a"), F.col("filename").alias("b"), F.lit("").alias("phase"))


def anchor_insert(cand: DataFrame, links: DataFrame, total: int, edges: DataFrame) -> DataFrame:
    """The least compared image outside the seed pool, and the unseen image nearest in mean that is on no common path."""
    outside = cand.join(seed_pool(cand, total).select("filename"), "filename", "left_anti")
    by_level = {r[0]: r[1] for r in outside.where(F.col("n") <= RANKING.insertion_target).groupBy("n").count().collect()}
    pool, threshold = 0, 0
    for threshold in range(RANKING.insertion_target + 1):
        pool += by_level.get(threshold, 0)
        if pool >= max(threshold + 2, RANKING.reserve_count):
            break
    if pool < RANKING.reserve_count:
        return _none(cand)
    nodes = outside.where(F.col("n") <= threshold)
    source = scratch(nodes.orderBy("n", "skill", "filename").limit(1), "source")
    near = _unseen_by(source, _against(source, nodes), links)
    return _one(graph.same_path(near, edges, None).where("not same_path").orderBy("mu_gap", "b"), "anchor_insert")


def collapsible(cand: DataFrame, chain: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Two chain ends: of the ten least compared images with losses only, else with wins only."""
    ends = graph.chain_extremes(chain)
    for side, only in (("last", only_losers), ("first", only_winners)):
        names = ends.select(F.col(side).alias("filename")).distinct()
        few = cand.join(names, "filename", "left_semi").join(only(comparisons), "filename", "left_semi").orderBy("n", "filename").limit(10)
        if few.count() >= 2:
            first = few.orderBy("n", "filename").limit(1)
            return _one(widest_within(_against(first, few)), "collapsible")
    return _none(cand)


def single_win_loss(cand: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours by count among images above the insertion target with exactly one win, or else one loss."""
    for own, other in (("winner", "loser"), ("loser", "winner")):
        ones = edges.groupBy(F.col(own).alias("filename")).agg(F.count_distinct(other).alias("k")).where("k = 1").select("filename")
        few = cand.where(F.col("n") > RANKING.insertion_target).join(ones, "filename", "left_semi").orderBy("filename").limit(101)
        w = W.orderBy("n", "filename")
        p = few.select(
            F.row_number().over(w).alias("place"), F.col("filename").alias("a"), F.lead("filename").over(w).alias("b"), F.abs(F.col("skill") - F.lead("skill").over(w)).alias("gap"), "sigma",
        ).where("b is not null")
        out = _one(closest_pair(p), "single_win_loss")
        if out.count():
            return out
    return _none(cand)


def chain_merge(cand: DataFrame, chain: DataFrame, edges: DataFrame, labels: DataFrame, recent: tuple[str, ...] = (), block: int = 200) -> DataFrame:
    """Main nodes of a short and of a long chain with scores close together and no common path.

    Scores are put into buckets as wide as the allowed gap, and neighbouring buckets joined, so no chain meets
    every other. Pairs are tested for a common path block by block, in order, until a block has one without; a block
    has four times as many as the last, up to a million.
    """
    if chain.count() < RANKING.min_chains:
        return _none(cand)
    top = graph.sorted_chains(chain.where(~F.col("chain_id").isin(list(recent))) if recent else chain).limit(RANKING.min_chains * 10)
    owned = (chain.where(~F.col("chain_id").isin(list(recent))) if recent else chain).select("chain_id", "length", F.explode("owners").alias("node"))  # owners are among the chain's nodes
    main = scratch(owned.join(cand.withColumnRenamed("filename", "node"), "node"), "main")  # written, as each block reads it
    bucket = F.floor(F.col("score") / RANKING.chain_gap)
    left = main.join(top.select("chain_id"), "chain_id", "left_semi").where(F.col("n") > RANKING.insertion_target)
    left = left.select(F.col("node").alias("a"), F.col("chain_id").alias("ca"), F.col("length").alias("la"), F.col("score").alias("sa"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k"))
    right = main.select(F.col("node").alias("b"), F.col("chain_id").alias("cb"), F.col("length").alias("lb"), F.col("score").alias("sb"), bucket.alias("k"))
    later = (F.col("lb") > F.col("la")) | ((F.col("lb") == F.col("la")) & (F.col("cb") > F.col("ca")))
    p = left.join(right, "k").where(later & (F.abs(F.col("sa") - F.col("sb")) <= RANKING.chain_gap) & (F.col("a") != F.col("b")))
    order = [F.asc("la"), F.asc("ca"), F.desc("lb"), F.desc("cb"), F.asc("a"), F.asc("b")]
    done, size = 0, block
    while True:
        some = scratch(p.orderBy(*order).offset(done).limit(size))
        found = scratch(_one(graph.same_path(some, edges, labels, chain).where("not same_path").orderBy(*order), "chain_merge"))
        if found.count() or some.count() < size:
            return found
        done, size = done + size, min(size * 4, 1 << 20)


def uncertainty(cand: DataFrame, links: DataFrame, total: int, edges: DataFrame) -> DataFrame:
    """The most uncertain image outside the seed pool, and the unseen seed nearest in mean on no common path."""
    seeds = seed_pool(cand, total)
    usable = cand.where(F.col("n") > RANKING.insertion_target)
    one = usable.where(F.col("sigma") >= RANKING.sigma_threshold).join(seeds.select("filename"), "filename", "left_anti").orderBy(F.desc("sigma"), "filename").limit(1)
    one = scratch(one, "source")
    near = _unseen_by(one, _against(one, usable.join(seeds.select("filename"), "filename", "left_semi")), links)
    return _one(graph.same_path(near, edges, None).where("not same_path").orderBy("mu_gap", "b"), "uncertainty")


def fallback(cand: DataFrame, links: DataFrame) -> DataFrame:
    """The first unseen pair by comparison count.

    An image with k partners has an unseen one among any k + 1 others, so each image needs only as many of the
    next images by count as it has links, and one more.
    """
    n = links.count()
    some = cand.orderBy("n", "filename").limit(int((2 * n) ** 0.5) + 3)
    ranked = scratch(some.withColumn("r", F.row_number().over(W.orderBy("n", "filename"))).select("filename", "r"), "ranked")
    a, b = (ranked.select(F.col("filename").alias(f"filename_{x}"), F.col("r").alias(f"r{x}")) for x in "ab")
    joined = links.select("filename_a", "filename_b").distinct().join(a, "filename_a").join(b, "filename_b").where("ra <> rb")
    met = scratch(joined.select(F.least("ra", "rb").alias("r"), F.greatest("ra", "rb").alias("other")), "met")
    later = ranked.join(met.groupBy("r").agg(F.count("*").alias("k")), "r", "left").select("r", "filename", F.coalesce("k", F.lit(0)).alias("k"))
    first = later.where(F.col("k") < F.lit(ranked.count()) - F.col("r")).orderBy("r").first()  # the first that has not met all later ones
    if first is None:
        return _none(cand)
    others = ranked.where((F.col("r") > first.r) & (F.col("r") <= first.r + first.k + 1)).join(met.where(F.col("r") == first.r).select(F.col("other").alias("r")), "r", "left_anti")
    return _one(others.orderBy("r").select(F.lit(first.filename).alias("a"), F.col("filename").alias("b")), "fallback")


def next_pair(images: DataFrame, comparisons: DataFrame, exclude: DataFrame | None = None, start: str = PHASES[0]) -> DataFrame:
    """(a, b, phase): the pair of the first phase, from `start` on, that has one; no row if none has."""
    cand = candidates(images if exclude is None else images.join(exclude, "filename", "left_anti"))
    cand = scratch(cand)
    total = images.count()
    edges = scratch(graph.edges(comparisons))
    links = scratch(comparisons.select(F.least("filename_a", "filename_b").alias("filename_a"), F.greatest("filename_a", "filename_b").alias("filename_b")).distinct())
    known: dict[str, DataFrame] = {}

    def labels() -> DataFrame:
        if "labels" not in known:
            known["labels"] = graph.components(graph.universe(edges, images), edges)
        return known["labels"]

    def chain() -> DataFrame:
        if "chain" not in known:
            known["chain"] = scratch(graph.chains(labels(), edges))
        return known["chain"]

    steps = {
        "seed_coverage": lambda: seed_coverage(cand, links, total),
        "anchor_insert": lambda: anchor_insert(cand, links, total, edges),
        "collapsible": lambda: collapsible(cand, chain(), comparisons),
        "single_win_loss": lambda: single_win_loss(cand, edges),
        "chain_merge": lambda: chain_merge(cand, chain(), edges, labels()),
        "uncertainty": lambda: uncertainty(cand, links, total, edges),
        "fallback": lambda: fallback(cand, links),
    }
    for name in PHASES[PHASES.index(start) :]:
        found = scratch(steps[name]())
        if found.count():
            return found
    return _none(cand)


def choose(images: DataFrame, comparisons: DataFrame, skip: int = 0, exclude: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(next_pair, the phase to start from next time): phases before the last successful one are skipped.

    The memory is the caller's to keep; it is forgotten whenever the number of comparisons is a multiple of the reserve count.
    """
    if comparisons.count() % RANKING.reserve_count == 0:
        skip = 0
    found = next_pair(images, comparisons, exclude, PHASES[skip])
    row = found.first()
    return found, skip if row is None else PHASES.index(row.phase)


def describe(images: DataFrame, wins: DataFrame, labels: DataFrame | None, height: DataFrame) -> DataFrame:
    """What is shown of an image: rating, wins and losses, component and height. Without labels, height has the components (see graph.placed)."""
    i = images.select("filename", F.round("score", 4).alias("score"), F.round("rating_mu", 4).alias("mu"), F.round("rating_sigma", 4).alias("sigma"), "comparison_count")
    zero: Column = F.lit(0)
    j = i.join(wins, "filename", "left").join(height.withColumnRenamed("node", "filename"), "filename", "left")
    if labels is not None:
        j = j.join(labels.withColumnRenamed("node", "filename"), "filename", "left")
    return j.select(*i.columns, F.coalesce("wins", zero).alias("wins"), F.coalesce("losses", zero).alias("losses"), "component", F.coalesce("height", F.lit(1)).alias("height"))
