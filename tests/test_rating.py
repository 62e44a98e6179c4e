"""Rating arithmetic and replay."""

import math
import random

import pytest
from pyspark.sql import functions as F

from duelframe.functions import rating_math
from duelframe.operators import rating
from duelframe.streaming import ingest


def test_update_moves_towards_the_result():
    (mw, sw), (ml, sl) = rating_math.update((25.0, 25 / 3), (25.0, 25 / 3))
    assert mw > 25 > ml and math.isclose(mw - 25, 25 - ml) and sw < 25 / 3 and math.isclose(sw, sl)
    # by hand: c^2 = 2 (25/6)^2 + 2 ((25/3)^2 + (1/12)^2), t = 0, v = 2 phi(0)
    var = (25 / 3) ** 2 + (1 / 12) ** 2
    c2 = 2 * (25 / 6) ** 2 + 2 * var
    v = 2 / math.sqrt(2 * math.pi)
    assert math.isclose(mw, 25 + var / math.sqrt(c2) * v) and math.isclose(sw, math.sqrt(var * (1 - var / c2 * v * v)))


def test_columns_are_the_function(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(0, 50), rng.uniform(0.5, 9), rng.uniform(0, 50), rng.uniform(0.5, 9)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    out = df.select("*", *[c.alias(n) for n, c in rating_math.update_columns(F.col("a"), F.col("b"), F.col("c"), F.col("d")).items()])
    for r in out.collect():
        (mw, sw), (ml, sl) = rating_math.update((r.a, r.b), (r.c, r.d))
        for x, y in ((r.new_mu_w, mw), (r.new_sigma_w, sw), (r.new_mu_l, ml), (r.new_sigma_l, sl)):
            assert math.isclose(x, y, rel_tol=1e-9)


def history(spark, n=300, names=25, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.sample([f"g{i % 3}_{k}" for k in range(names)], 2)
        rows.append((i, a, b, rng.choice((a, b))))
    rows.append((n, "x", "y", "nobody"))
    return spark.createDataFrame(rows, "id long, filename_a string, filename_b string, winner string"), rows


def test_replay_is_the_sequential_fold(spark):
    df, rows = history(spark)
    for order, seq in (("default", rows), ("reverse", rows[::-1])):
        want = {}
        for _, a, b, w in seq:
            if w in (a, b):
                lo = b if w == a else a
                x, y = want.get(w, (25.0, 25 / 3, 0)), want.get(lo, (25.0, 25 / 3, 0))
                p, q = rating_math.update(x[:2], y[:2])
                want[w], want[lo] = (*p, x[2] + 1), (*q, y[2] + 1)
        got = {r.filename: r for r in rating.replay(df, order).collect()}
        assert set(got) == set(want)
        for k, (m, s, n) in want.items():
            assert math.isclose(got[k].mu, m) and math.isclose(got[k].sigma, s) and got[k].n == n


@pytest.mark.parametrize("limit", [50, 1000])
def test_windows_of_a_giant_component_are_the_fold(spark, limit):
    """One component with a hub in a third of all comparisons, self-comparisons and equal ids; no group above the limit."""
    rng = random.Random(limit)
    rows = []
    for i in range(240):
        a, b = rng.sample([f"g{k:03d}" for k in range(90)], 2)
        if i % 3 == 0:
            a = "hub"
        rows.append((i // 2 if i % 50 == 0 else i, a, a if i == 77 else b, a if rng.random() < 0.5 else b))
    rows[77] = (77, rows[77][1], rows[77][1], rows[77][1])
    rows += [(1000 + i, f"x{i % 9}", f"y{i % 4}", f"x{i % 9}") for i in range(30)] + [(2000, "lost", None, "lost"), (2001, None, "lost", "lost")]
    df = spark.createDataFrame(rows, "id long, filename_a string, filename_b string, winner string")
    for order in ("default", "reverse"):
        seq = [(i, w, b if w == a else a) for i, a, b, w in rows if w in (a, b) and a and b]
        seq.sort(key=lambda r: (r[0] if order == "default" else -r[0], r[1], r[2]))
        want = rating.fold((w, lo) for _, w, lo in seq)
        got = {r.filename: r for r in rating.replay(df, order, limit=limit).collect()}
        assert set(got) == set(want)
        for k, (m, s, n) in want.items():
            assert math.isclose(got[k].mu, m, rel_tol=1e-9) and math.isclose(got[k].sigma, s, rel_tol=1e-9) and got[k].n == n


def test_large_components_share_their_windows(spark, monkeypatch):
    """Five large components are folded side by side, window by window: a call for each window of one of them, not of all comparisons."""
    rng = random.Random(8)
    rows = [(i, *rng.sample([f"{'abcde'[i % 5]}{k}" for k in range(12)], 2)) for i in range(500)]
    df = spark.createDataFrame([(i, a, b, a) for i, a, b in rows], "id long, filename_a string, filename_b string, winner string")
    calls, plain = [], rating._folded
    monkeypatch.setattr(rating, "_folded", lambda keyed, known: (calls.append(1), plain(keyed, known))[1])
    got = {r.filename: (r.mu, r.n) for r in rating.replay(df, limit=40).collect()}
    want = rating.fold((a, b) for _, a, b in rows)
    assert set(got) == set(want) and all(math.isclose(got[k][0], v[0]) and got[k][1] == v[2] for k, v in want.items())
    assert len(calls) == 3


def test_no_group_is_above_the_limit(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "hub" if i % 3 == 0 else f"g{rng.randrange(80)}", f"h{rng.randrange(80)}") for i in range(240)]
    df = spark.createDataFrame([(i, a, b, a) for i, a, b in rows], "id long, filename_a string, filename_b string, winner string")
    sizes, plain = [], rating._folded
    monkeypatch.setattr(rating, "_folded", lambda keyed, known: (sizes.append(keyed.groupBy("component").count().agg(F.max("count")).first()[0] or 0), plain(keyed, known))[1])
    assert rating.replay(df, limit=60).count() == len({x for r in rows for x in r[1:]})
    assert len(sizes) > 5 and max(sizes) <= 60


def test_orders(spark):
    df, _ = history(spark, 60)
    one = {r.filename: r.mu for r in rating.replay(df, "random", 1).collect()}
    assert one == {r.filename: r.mu for r in rating.replay(df, "random", 1).collect()}
    assert one != {r.filename: r.mu for r in rating.replay(df, "random", 2).collect()}
    with pytest.raises(ValueError, match="seed"):
        rating.replay(df, "random")
    with pytest.raises(ValueError, match="order"):
        rating.replay(df, "other")


def test_scores(spark):
    df = spark.createDataFrame([(25.0, 25 / 3), (35.0, 1.0), (15.0, 1.0)], "mu double, sigma double")
    s = [r[0] for r in df.select(rating_math.public_score(F.col("mu"), F.col("sigma"))).collect()]
    assert s[0] == 0.5 and s[2] < 0.5 < s[1] and math.isclose(s[1] + s[2], 1)


def test_live_ratings_are_the_fold(spark, tmp_path):
    df, rows = history(spark, 90)
    src = str(tmp_path / "in")
    good = df.where("winner <> 'nobody'").select(F.substring("winner", 1, 2).alias("pool"), "id", "winner", F.when(F.col("winner") == F.col("filename_a"), F.col("filename_b")).otherwise(F.col("filename_a")).alias("loser"))
    for k in range(3):
        good.where(f"id >= {30 * k} and id < {30 * k + 30}").coalesce(1).write.mode("append").parquet(src)
    stream = ingest.file_stream(spark, src, good.schema, 1)
    out = ingest.run_once(ingest.live_ratings(stream), "live_test", str(tmp_path / "cp"), "update")
    last = {}
    for r in out.collect():
        if r.filename not in last or r.n > last[r.filename].n:
            last[r.filename] = r
    want = {r.filename: r for r in rating.replay(df).collect()}
    files_in_order = sum(r.n for r in last.values()) == sum(r.n for r in want.values())
    assert set(last) == set(want) and files_in_order
    assert all(last[k].n == want[k].n for k in want)


def test_recent_names_are_bounded(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("g", f"f{k}") for k in range(30)], "pool string, name string").coalesce(1).write.parquet(src)
    s = ingest.recent(ingest.file_stream(spark, src, "pool string, name string"), "pool", "name", 5)
    assert len(ingest.run_once(s, "recent_test", str(tmp_path / "cp"), "update").collect()[0].recent) == 5


def test_whole_ids_are_not_sorted_before(spark, monkeypatch):
    """Ids that are whole numbers order the comparisons themselves; others are numbered by a sort, with the same ratings."""
    rng = random.Random(9)
    rows = [(None if i == 5 else i // 2 - 20, *rng.sample([f"g{k}" for k in range(30)], 2)) for i in range(200)]
    df = spark.createDataFrame([(i, a, b, a) for i, a, b in rows], "id long, filename_a string, filename_b string, winner string")
    sorts, plain = [], rating.dense_order
    monkeypatch.setattr(rating, "dense_order", lambda *a, **k: (sorts.append(k.get("name", "nth")), plain(*a, **k))[1])
    for order in ("default", "reverse"):
        for limit in (1000, 40):
            sorts.clear()
            got, text = ({r.filename: (r.mu, r.sigma, r.n) for r in rating.replay(x, order, limit=limit).collect()} for x in (df, df.withColumn("id", F.lpad((F.col("id") + 100).cast("string"), 5, "0"))))
            assert got == text and len(got) == 30
            assert sorts == (["nth"] if limit == 1000 else ["at", "nth", "at"])


def test_images_of_whole_components_are_not_looked_up(spark, monkeypatch):
    """Where components are cut by time alone, each image's rating stays with its component: no exchange but the one by component."""
    rng = random.Random(4)
    rows = [(i, *rng.sample([f"{'ab'[i % 2]}{k}" for k in range(12)], 2)) for i in range(200)]
    df = spark.createDataFrame([(i, a, b, a) for i, a, b in rows], "id long, filename_a string, filename_b string, winner string")
    joins, plain = [], rating._folded
    monkeypatch.setattr(rating, "_folded", lambda keyed, known: (joins.append(known is not None and "Join" in known._jdf.queryExecution().toString()), plain(keyed, known))[1])
    got = {r.filename: r.mu for r in rating.replay(df, limit=40).collect()}
    want = rating.fold((a, b) for _, a, b in rows)
    assert set(got) == set(want) and all(math.isclose(got[k], v[0]) for k, v in want.items())
    assert joins == [False, False, False]
