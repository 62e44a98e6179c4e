"""Operator 1 learns from all trusted text of its half, and knows all of its words."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import plain_scores

from duelframe.llm import kneser_ney


def test_words_beyond_the_vocabulary_are_joined(spark):
    rng = random.Random(12)
    vocabulary = ["the", "a", "house", "Haus", "жук", "живой", "漢字", "über", "tree", "x1", "...", "!?", "1984"]
    known = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 30]))) for _ in range(60)]
    texts = [*known[:5], "the unseen words жуки and 漢 ϗ ǆ", "2077, 12 trees!", "a", "...", "x1 unseen x1 house"]
    trusted = spark.createDataFrame([(t,) for t in known], "text string")
    letters = kneser_ney.fit_letters(trusted)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for hot in (1 << 20, 3):
        pairs, words = kneser_ney.fit_words(trusted, vocabulary=3, hot=hot)
        assert len(words.known[0]) == 3
        got = {r.doc_id: (r.bits, r.words, r.worst) for r in kneser_ney.score(docs, letters, pairs, words, "doc_id", "text", "lang").collect()}
        for i, want in enumerate(plain_scores(known, texts)):
            assert got[i] == pytest.approx(want, rel=1e-4)


def test_texts_are_the_same_through_the_filter(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    ids = spark.range(0, 3000, 7).selectExpr("id AS _tid")
    few = kneser_ney.texts_of(docs, ids, "doc_id", "text")
    assert sorted(r.text for r in kneser_ney.texts_of(docs, ids, "doc_id", "text", few=0).collect()) == sorted(r.text for r in few.collect()) != []


def test_all_trusted_documents_of_the_half_are_learned_from(spark, monkeypatch):
    class Stop(Exception):
        pass

    def seen(trusted, text_col):
        raise Stop(trusted.count())

    monkeypatch.setattr(kneser_ney, "fit_letters", seen)
    docs = spark.range(24_000).selectExpr("id AS doc_id", "'a text' AS text", "'en' AS lang")
    with pytest.raises(Stop) as found:
        kneser_ney.classify(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    assert found.value.args[0] == docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).count() > 10_000


def test_letters_beyond_the_tables_are_joined(spark):
    rng = random.Random(12)
    vocabulary = ["the", "a", "house", "Haus", "жук", "живой", "漢字", "über", "tree", "x1", "...", "!?", "1984"]
    known = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 30]))) for _ in range(60)]
    texts = [*known[:5], "the unseen words жуки and 漢 ϗ ǆ", "2077, 12 trees!", "a", "...", "x1 unseen x1 house", "", "hearth hourse живот"]
    trusted = spark.createDataFrame([(t,) for t in known], "text string")
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for most, vocabulary in ((1 << 20, 1 << 22), (5, 1 << 22), (20, 3)):
        letters = kneser_ney.fit_letters(trusted, most=most)
        assert all(len(t[0]) <= most for t in letters.tables) and bool(letters.whole) == (most < 100)
        pairs, words = kneser_ney.fit_words(trusted, vocabulary=vocabulary, hot=3)
        got = {r.doc_id: (r.bits, r.words, r.worst) for r in kneser_ney.score(docs, letters, pairs, words, "doc_id", "text", "lang").collect()}
        for i, want in enumerate(plain_scores(known, [t or "a" for t in texts])):
            assert got[i] == (pytest.approx(want, rel=1e-4) if texts[i] else (None, None, None))


def test_whole_letters_change_no_row(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want, fit = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}, kneser_ney.fit_letters
    monkeypatch.setattr(kneser_ney, "fit_letters", lambda trusted, text_col: fit(trusted, text_col, most=300))
    got = kneser_ney.classify(docs, labels).collect()
    assert len(got) == len(want) > 0
    for r in got:
        assert r.keep == want[r.doc_id].keep
        for c in ("perplexity", "words", "worst"):
            assert r[c] == pytest.approx(want[r.doc_id][c], rel=1e-9)


def test_more_letters_than_one_symbol_holds():
    """Every letter keeps a spelling of its own beyond 65,534 of them."""
    cps = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    number = kneser_ney.numbers_of({c: k + 2 for k, c in enumerate(cps)})
    words = [chr(cps[0]) + chr(cps[-1]) + chr(cps[1]), *map(chr, cps[::7]), *map(chr, cps[-2000:]), ""]
    keys, begin = kneser_ney.letter_keys(number, words)
    spelled = [tuple(k) for k in np.split(keys, begin[1:])]
    assert len(set(spelled)) == len(set(words)) and len(spelled[0]) == 5 and len(spelled[1]) == 2 and len(spelled[-2]) == 3
    assert kneser_ney.Letters({c: k + 2 for k, c in enumerate(cps)}, []).floor > 1 / 0xFFFF
