"""Plans of steps that many queries share, against what they stand for."""

from pyspark.sql import functions as F

from duelframe import queries
from duelframe.operators import graph, growing, history
from duelframe.scratch import scratch
from duelframe.sources import fixtures

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_views_are_as_stated(spark):
    for name in ("dag", "images"):
        got, want = fixtures.view(spark, SF, name), fixtures.as_stated(spark, SF, name)
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_links_are_sorted_and_dealt_once(spark):
    plan = _plan(graph.edges(fixtures.dag_rows(spark, SF)))
    assert plan.count("Window [") == 1 and plan.count("Aggregate [") == 1


def test_images_sort_the_lines_once(spark):
    assert _plan(fixtures.view(spark, SF, "images")).count("Window [") == 1


def test_tallies_are_wins_and_losses(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b"), ("d", "a")], "winner string, loser string")
    assert {tuple(r) for r in history.tallies(links).collect()} == {("a", 2, 1), ("b", 0, 2), ("c", 1, 1), ("d", 1, 0)}


def test_placed_is_labels_and_heights(spark):
    chain = scratch(graph.chains(None, graph.edges(fixtures.dag_rows(spark, SF))))
    want = graph.chain_labels(chain).join(graph.heights(chain), "node").select("node", "component", "height")
    assert {tuple(r) for r in graph.placed(chain).collect()} == {tuple(r) for r in want.collect()}


def test_a_batch_of_links_is_several_files(spark, monkeypatch):
    files, plain = [], growing.GrowingGraph.apply
    monkeypatch.setattr(growing.GrowingGraph, "apply", lambda self, batch, number: (files.append(batch.select(F.input_file_name()).distinct().count()), plain(self, batch, number))[1])
    assert queries.queries()["x06_growing_graph"](spark, SF).count() > 0
    assert files == [spark.sparkContext.defaultParallelism] * 2
