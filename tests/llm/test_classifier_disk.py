"""Operator 1 keeps little on disk: passes, and tables and shuffles that go once they are read."""

import glob
import time

from pyspark.sql import functions as F

from duelframe import scratch
from duelframe.llm import kneser_ney


def test_passes_change_no_row(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd_docs.select("doc_id", "text", "lang"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one, three = (sorted((tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r) for r in kneser_ney.classify(docs, labels, passes=k).collect())) for k in (1, 3))
    assert one == three
    assert len(one) == docs.count()


def test_what_the_models_are_made_of_goes(spark, sf):
    known = set(scratch._WRITTEN)
    kneser_ney.op1_quality_classifier(spark, sf).count()
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(scratch._WRITTEN) - known}
    assert "scores" in left and not left & {"trusted", "word-pairs", "words", "pair-shares", "known-words", "frequent-words", "rare-words"}


def test_tables_of_rare_words_stay_while_they_are_joined(spark):
    trusted = spark.createDataFrame([("a b c d e f g a b a c a",), ("a b a h i j",)], "text string")
    known = set(scratch._WRITTEN)
    pairs, words = kneser_ney.fit_words(trusted, vocabulary=3, hot=1)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(scratch._WRITTEN) - known}
    assert left == {"pair-shares", "rare-words"}
    assert words.table.count() == 8 and pairs.count() > 0  # ten words and the end


def test_shuffle_files_go_when_the_query_has_ended(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)

    def files():
        return set(glob.glob("/tmp/**/shuffle_*_*.data", recursive=True))

    old = files()
    with scratch.shuffles_freed(spark):
        spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count().write.parquet(str(tmp_path / "counts"))
    assert spark.conf.get(key) == before
    until = time.time() + 20
    while files() - old and time.time() < until:
        time.sleep(0.2)
    assert not files() - old
    assert spark.read.parquet(str(tmp_path / "counts")).count() == 1000


def test_discard_deletes_that_table_alone(spark):
    a, b = scratch.scratch(spark.range(10), "table"), scratch.scratch(spark.range(20), "table")
    scratch.discard(a.where("id > 3").select("id"))
    assert not a.inputFiles() or not glob.glob(a.inputFiles()[0].removeprefix("file://"))
    assert b.count() == 20


def test_pairs_without_rare_words_pass_by_their_joins(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plain, joined, fit = kneser_ney.classify(docs, labels), [], kneser_ney.fit_words
    want = {r.doc_id: r for r in plain.collect()}
    monkeypatch.setattr(kneser_ney, "fit_words", lambda trusted, text_col: fit(trusted, text_col, vocabulary=500))
    monkeypatch.setattr(kneser_ney, "discard", lambda *tables: joined.extend(t for t in tables if "w" in t.columns))
    got = kneser_ney.classify(docs, labels).collect()
    assert len(joined) == 4 and sum(t.where("doc is not null").count() for t in joined) == len(got) == len(want)
    for t in joined:
        rows = {(r.plain, r.short): r["count"] for r in t.where("base is not null").selectExpr("w is null and c is null AS plain", "low is null AS short").groupBy("plain", "short").count().collect()}
        assert set(rows) == {(True, True), (False, False)}
    for r in got:
        assert r.keep == want[r.doc_id].keep and abs(r.words - want[r.doc_id].words) <= 1e-6 * r.words and abs(r.worst - want[r.doc_id].worst) <= 1e-6 * r.worst
