"""Keyed state: several files, keys and micro-batches, a restart in between, against the fold of the whole."""

import math
import random

from duelframe.operators import graph, rating
from duelframe.streaming import ingest, keyed


def duels(seed=4, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.sample([f"g{i % 4}_{k}" for k in range(9)], 2)
        out.append((i, a, b))
    return out


def put(spark, rows, folder, files):
    spark.createDataFrame(rows, "id long, winner string, loser string").repartition(files).write.mode("append").parquet(folder)


def test_keyed_ratings_are_the_fold_after_a_restart(spark, tmp_path):
    rows, folder, table, checkpoint = duels(), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    links = spark.createDataFrame([r[1:] for r in rows], "winner string, loser string")
    labels = graph.components(graph.universe(links), links)
    assert labels.select("component").distinct().count() == 4
    put(spark, rows[:100], folder, 3)

    def run():
        return keyed.stream_to_table(keyed.keyed_ratings(ingest.file_stream(spark, folder, "id long, winner string, loser string", 3), labels), checkpoint, table)

    first = run()
    assert {r.filename: r.n for r in keyed.latest(first, "filename").collect()} == {k: v[2] for k, v in rating.fold((w, lo) for _, w, lo in rows[:100]).items()}
    put(spark, rows[100:170], folder, 3)
    put(spark, [*rows[170:], (999, "g0_1", "g0_1")], folder, 3)
    second = run()
    assert second.select("batch").distinct().count() == 3
    want = rating.fold((w, lo) for _, w, lo in rows)
    got = {r.filename: r for r in keyed.latest(second, "filename").collect()}
    assert set(got) == set(want) and all(math.isclose(got[k].mu, m) and math.isclose(got[k].sigma, s) and got[k].n == n for k, (m, s, n) in want.items())


def test_rated_tables_are_the_fold_after_a_restart(spark, tmp_path):
    """As keyed state, with negative and equal ids, and without a call for each component."""
    rows, folder, table, checkpoint = [(i // 2 * 2 - 300, a, b) for i, a, b in duels()], str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    links = spark.createDataFrame([r[1:] for r in rows], "winner string, loser string")
    labels = graph.components(graph.universe(links), links)
    for part in (rows[:100], [*rows[100:], (999, "g0_1", "g0_1")]):
        put(spark, part, folder, 3)
        out = keyed.rate_to_table(ingest.file_stream(spark, folder, "id long, winner string, loser string", 3), labels, checkpoint, table)
    assert out.select("batch").distinct().count() == 2
    want = rating.fold((w, lo) for _, w, lo in sorted(rows))
    got = {r.filename: r for r in keyed.latest(out, "filename").collect()}
    assert set(got) == set(want) and all(math.isclose(got[k].mu, m) and math.isclose(got[k].sigma, s) and got[k].n == n for k, (m, s, n) in want.items())


def test_recent_names_over_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b"]), f"u{rng.randrange(60)}") for i in range(300)]
    folder = str(tmp_path / "in")
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame([*part, (None, None, None)], "place long, pool string, name string").repartition(2).write.mode("append").parquet(folder)
    stream = ingest.file_stream(spark, folder, "place long, pool string, name string", 2)
    table = keyed.stream_to_table(keyed.keyed_recent(stream, "pool", "name", "place", 5, 1.0, 3), str(tmp_path / "cp"))
    want = {}
    for _, pool, name in rows:
        want[pool] = [name, *[x for x in want.get(pool, []) if x != name]][:5]
    assert {r.pool: r.recent for r in keyed.recent_names(table, 5).collect()} == want
    assert table.where("size(names) > 5").count() == 0


def test_a_full_key_is_trimmed(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(i, "p", f"u{i:02}") for i in range(9)], "place long, pool string, name string").write.parquet(folder)
    stream = ingest.file_stream(spark, folder, "place long, pool string, name string")
    table = keyed.stream_to_table(keyed.keyed_recent(stream, "pool", "name", "place", 8, 0.75, 1), str(tmp_path / "cp"))
    assert table.first().names == [f"u{i:02}" for i in range(8, 2, -1)]
