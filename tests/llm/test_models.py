"""Quality classifier, Jaccard join, embeddings, language-model scores and the pipeline."""

import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from sql_twin import same_as_sql  # isort: skip

from duelframe.llm import hnsw, jaccard, kneser_ney, mixing, registry
from duelframe.llm.common import connected_components, forest, scratch, sweep, vocabulary


def plain_kneser_ney(grams):
    """{gram: share}, {context: gamma} of counted (context, last) pairs, by the formulas."""
    of = Counter(min(n, 4) for n in grams.values())
    n1, n2, n3, n4 = (of[k] or 0.5 for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [min(max(v, 0.1), k - 0.1) for k, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
    total, off = Counter(), Counter()
    for (ctx, _), n in grams.items():
        total[ctx] += n
        off[ctx] += d[min(n, 3) - 1]
    return {g: (n - d[min(n, 3) - 1]) / total[g[0]] for g, n in grams.items()}, {c: off[c] / total[c] for c in total}


def plain_scores(sample, texts):
    """(bits by letters, bits by words, worst word) of texts after a model of sample, without Spark and tables."""
    def words(t):
        return [*kneser_ney._WORD.findall(t.lower()), ""]

    def fold(w):
        return tuple(kneser_ney._kind(c) for c in w)

    alphabet = {c for t in sample for w in words(t) for c in fold(w)} | {fold(c)[0] for t in sample for c in t.lower()}
    counts = Counter()
    for t in sample:
        for w in words(t):
            s = ("<",) * 3 + fold(w) + ("<",)
            counts.update((s[i : i + 3], s[i + 3]) for i in range(len(s) - 3))
    orders = [plain_kneser_ney(counts)]
    for k in (2, 1, 0):
        counts = Counter((ctx[1:], c) for ctx, c in set(counts))
        orders.insert(0, plain_kneser_ney(counts))

    def spell(w):
        s, out = ("<",) * 3 + tuple(c if c in alphabet else "?" for c in fold(w)) + ("<",), 0.0
        for i in range(3, len(s)):
            p = 1 / (len(alphabet) + 2)
            for k, (share, gamma) in enumerate(orders):
                ctx = s[i - k : i]
                p = share.get((ctx, s[i]), 0.0) + gamma.get(ctx, 1.0) * p
            out -= math.log2(p)
        return out

    pairs = Counter(p for t in sample for p in zip([None, *words(t)], words(t), strict=False))
    share2, gamma = plain_kneser_ney(pairs)
    share1, weight = plain_kneser_ney(Counter((0, w) for _, w in pairs))
    out = []
    for t in texts:
        letters = bits = size = worst = 0.0
        for before, w in zip([None, *words(t)], words(t), strict=False):
            one = share1.get((0, w), 0.0) + weight[0] * 2 ** -spell(w)
            b = -math.log2(share2.get((before, w), 0.0) + gamma.get(before, 1.0) * one)
            letters, bits, size = letters + spell(w), bits + b, size + len(w) + 1
            if w:
                worst = max(worst, b / (len(w) + 1))
        out.append((letters / size, bits / size, worst))
    return out


def test_kneser_ney_by_the_formulas(spark):
    rng = random.Random(12)
    vocabulary_ = ["the", "a", "house", "Haus", "жук", "живой", "漢字", "über", "tree", "x1", "...", "!?", "1984"]
    sample = [" ".join(rng.choices(vocabulary_, k=rng.choice([1, 5, 30]))) for _ in range(60)]
    texts = [*sample[:5], "the unseen words жуки и 漢 ϗ ǆ", "2077, 12 trees!", "a", "..."]
    trusted = spark.createDataFrame([(t,) for t in sample], "text string")
    letters = kneser_ney.fit_letters(trusted)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for hot in (1 << 20, 3):  # with and without pairs that are joined
        pairs, words = kneser_ney.fit_words(trusted, hot=hot)
        got = {r.doc_id: (r.bits, r.words, r.worst) for r in kneser_ney.score(docs, letters, pairs, words, "doc_id", "text", "lang").collect()}
        for i, want in enumerate(plain_scores(sample, texts)):
            assert got[i] == pytest.approx(want, rel=1e-4)
    once = [*[a for a in "abcdef"], "жук"]
    keys, begin = letters.keys(once)
    assert len(keys) == sum(len(w) + 1 for w in once) and begin.tolist() == np.cumsum([0, *[len(w) + 1 for w in once[:-1]]]).tolist()


def test_classifier_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    out = kneser_ney.op1_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rate = {(r.quality, r.toxic): r.kept for r in out.groupBy("quality", "toxic").agg({"keep": "count"}).join(out.where("keep").groupBy("quality", "toxic").count().withColumnRenamed("count", "kept"), ["quality", "toxic"], "left").collect()}
    n = {(r.quality, r.toxic): r["count"] for r in out.groupBy("quality", "toxic").count().collect()}
    assert rate[1, 0] / n[1, 0] > 0.97
    assert (rate[0, 0] or 0) / n[0, 0] < 0.35


def test_classifier_rejects_a_few_insults_in_fluent_text(spark):
    d = "/root/testdata/sf0.1"
    out = kneser_ney.op1_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    kept = {(r.quality, r.toxic): r.kept for r in out.groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert kept[1, 0] > 0.98 and kept[1, 1] < 0.38 and kept[0, 0] < 0.12 and kept[0, 1] < 0.08
    english = {r.toxic: r.kept for r in out.where("lang = 'en' and quality = 1").groupBy("toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert english[1] < 0.02 and english[0] > 0.97  # in other languages the labelled texts hold no insults

    rng = random.Random(4)
    words = ["".join(rng.choice(["tion", "er", "an", "re", "in", "the", "on"]) for _ in range(rng.randint(1, 3))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(words, k=300)), "en") for i in range(500)]
    rows.append((500, rows[1][1] + " scumbag " + rows[2][1], "en"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert not got[500].keep and got[500].low <= got[500].perplexity < got[500].high and got[500].worst > got[500].worst_high
    assert sum(got[i].keep for i in range(500)) > 480


def test_classifier_takes_quantiles_of_any_number_of_texts(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("qxzjwvkp") for _ in range(n))
    text = lambda: " ".join(rng.choices(["one", "two", "three", "four", "five"], k=rng.choice([20, 60, 300])))
    rows = [(i, text(), rng.choice(["en", "de"])) for i in range(3000)] + [(i, noise(300), "en") for i in range(3000, 3002)]
    rows += [(5000, noise(200), "xx"), (5001, noise(40), "en"), (5002, text(), "xx"), (5003, noise(30_000), "de")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3002)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert not any(got[i].keep for i in (5000, 5001, 5003)) and got[5002].keep
    few = {r.doc_id: r for r in kneser_ney.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels, least=10_000).collect()}
    assert not any(few[i].keep for i in (5000, 5001, 5003)) and few[5002].keep and len({r.high for r in few.values()}) == 1


def test_classifier_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (9, 1, None), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(odd_docs, labels).collect()
    assert len(got) == 11 and not any(r.keep for r in got if r.doc_id in (2, 3))
    assert kneser_ney.classify(no_docs, labels).count() == 0
    assert kneser_ney.classify(odd_docs, labels.where("false")).where("keep").count() == 9


def test_jaccard(spark, sf, duck, odd_docs, no_docs):
    same_as_sql(duck, jaccard.op8_ngram_jaccard_join(spark, sf), jaccard.OP8_SQL)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = jaccard.jaccard_links(docs, block=2, verify_block=2)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, jaccard.jaccard_links(docs).collect()))
    got = {r.doc_id: r for r in jaccard.jaccard_links(odd_docs).collect()}
    assert got[9].class_id == 1 and got[2].class_id == 2 and got[3].n_links == 0 and got[None].class_id is None and got[6].class_id == 5
    kept = jaccard.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 7, 8]
    assert jaccard.jaccard_links(no_docs).count() == 0


def test_pruning_bounds():
    least = jaccard.least_matches(0.8, 1e-6)
    assert least == sorted(least) and all(m <= 0.8 * n for m, n in zip(least, range(16, 129, 16), strict=True))


def plain_links(rows, threshold=0.93):
    """{id: (links, component)} by all pairs of a label."""
    x = {i: np.array(v) for i, v, _ in rows}
    near = {i: {j for j, w, k in rows if k == lab and j != i and (x[i] * x[j]).sum() / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= threshold} for i, v, lab in rows}
    out = {}
    for i in sorted(near):
        reach, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - reach
            reach |= new
            todo += new
        out[i] = (len(near[i]), min(reach))
    return out


@pytest.fixture(scope="module")
def clumps():
    """Vectors with many links: equal ones, near ones, chains along the threshold, and single ones."""
    rng = np.random.default_rng(5)
    rows = []
    for label in (1, 2):
        for _ in range(6):
            c = rng.normal(size=16)
            rows += [c + rng.uniform(0.02, 0.3) * rng.normal(size=16) for _ in range(rng.integers(5, 40))]
            rows += [c] * int(rng.integers(1, 9))
        rows += list(rng.normal(size=(60, 16)))
        angle = np.arange(40) * 0.35
        rows += [np.concatenate([[np.cos(a), np.sin(a)], np.zeros(14)]) for a in angle[:9]]
        rows = [r if isinstance(r, tuple) else (r, label) for r in rows]
    order = rng.permutation(len(rows))
    return [(int(i), [float(y) for y in rows[k][0]], rows[k][1]) for i, k in enumerate(order)]


def test_near_vectors(spark, sf, duck, clumps):
    same_as_sql(duck, hnsw.op9_embedding_near_dedup(spark, sf), hnsw.OP9_SQL)
    want = plain_links(clumps)
    df = spark.createDataFrame(clumps, "vec_id long, embedding array<double>, label int")
    assert sum(n > 0 for n, _ in want.values()) > 200
    audit = []
    for rows, kw in ((df, {}), (df, {"shard_rows": 40, "audit": audit}), (df.withColumn("vec_id", F.format_string("v%05d", "vec_id")), {"shard_rows": 90})):
        got = {int(str(r.vec_id).strip("v")): (r.n_links, int(str(r.component_id).strip("v"))) for r in hnsw.near_vectors(rows, **kw).collect()}
        assert got == want
    assert audit[1] >= 0.99 * audit[0] > 0


def test_a_clump_of_five_thousand(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=32)
    x = np.concatenate([np.tile(c, (2000, 1)), c + 0.1 * rng.normal(size=(3000, 32)), rng.normal(size=(500, 32))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_vectors(df, shard_rows=2000).collect()}
    assert all(got[i][0] == n for i, n in enumerate(want.tolist())) and {got[i][1] for i in range(5000)} == {0}


def test_near_vectors_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (10, [float("inf"), 1.0], 1), (11, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS shard", "3 AS v")
    got = hnsw.near_vectors(df).collect()
    assert len(got) == 13
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (1, 1, True) and by[2] == (1, 1, False) and by[None] == (0, None, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert hnsw.near_vectors(df.where("false")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    x[1000:2000] = x[:1000] + 0.05 * rng.normal(size=(1000, 24))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    shard = hnsw.Shard(np.arange(3000), x, np.ones(3000, np.int64))
    links, edges, asked, got = hnsw.within_shard(shard, 0.93)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert (links == want).all() and asked > 500 and got >= 0.99 * asked and shard.start < 128  # by searches, not by widening to all
    turned, origin = hnsw.probes(unit, 0.93)
    assert np.allclose((turned * unit[origin]).sum(axis=1), 0.93) and np.allclose(np.linalg.norm(turned, axis=1), 1)


def test_mixing(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df, frequent in ((docs, 200_000), (docs, 20), (odd_docs, 3)):
        texts = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]

        def held(i):
            return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1

        counts = Counter(w for i, t in texts if not held(i) for w in [*t.lower().split(), b""])
        n, v = sum(counts.values()), len(counts)
        want = sorted(((i, held(i), len(t.split()) + 1, sum(w in counts for w in [*t.lower().split(), b""]), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.lower().split(), b""]), 6)) for i, t in texts), key=repr)
        got = mixing.score_documents(df, frequent=frequent).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
        assert all(r.score < 0 for r in got)
    assert mixing.score_documents(no_docs).count() == 0


def test_mixing_is_a_distribution(spark, sf):
    model = mixing.fit(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    for context in (b"", b"the", b"zzzz9", "é".encode()):
        before = np.concatenate(list(mixing.windows(context)))[-1] if context else next(iter(mixing.windows(b"")))[0]
        base = (np.uint64(before) >> np.uint64(9)) << np.uint64(9)
        assert abs((10 ** model.logp(base | np.arange(257, dtype=np.uint64))).sum() - 1) < 1e-6
    text = b"and the " * 40
    w = np.concatenate(list(mixing.windows(text)))
    assert np.array_equal(w, np.concatenate(list(mixing.windows(text, size=7))))
    scorer = mixing.Scorer(model, bits=4)
    for _ in range(3):
        assert np.allclose(scorer(w), model.logp(w))


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1050)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent)}
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == want | {3: want.get(3, 3)}
    star = forest(np.array([p for p in pairs if p[0] != p[1]]))
    assert {int(m): int(r) for r, m in star} == {x: c for x, c in want.items() if x != c}


def test_registry(spark):
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def staged(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out.append(docs)
    return out


def test_pipeline(spark, sf, staged):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert all(s.columns == docs.columns for s in staged[:-1])
    n = [docs.count(), *(s.count() for s in staged[:-1])]
    assert n == sorted(n, reverse=True) and n[2] < n[0]
    want = sorted((r.doc_id, r.piece, r.ids_crc32) for r in staged[-1].collect())
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()) == want
    near = jaccard.jaccard_links(staged[1])
    assert near.where("n_links > 0").count() == 0
    assert {r.doc_id for r in staged[-1].select("doc_id").collect()} == {r.doc_id for r in staged[3].select("doc_id").collect()}


def test_stages_take_odd_rows(spark, sf, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (docs, docs.where("false")):
            out = stage(spark, df, sf)
            assert out.count() >= 0 and (k == 4 or out.columns == docs.columns)
    assert vocabulary("word_bpe_49k.json").endswith("word_bpe_49k.json")


def test_stages_part_texts_of_one_id(spark, sf, staged):
    """Of two texts of one id (or of none) a stage takes the bad one alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = random.Random(2)
    junk = [" ".join("".join(rng.choices("qxzjkvw", k=9)) for _ in range(60)) for _ in range(10)]
    good = staged[0].select(*docs.columns).where("doc_id is not null").orderBy("doc_id").limit(10).collect()
    rows = [(own, t, g.lang, g.source, len(t)) for own in (1, None) for g, t in zip(good, junk, strict=True)]
    rows = [(g.doc_id if r[0] else None, *r[1:]) for r, g in zip(rows, good * 2, strict=True)]
    left = corpus_pipeline.quality(spark, docs.union(spark.createDataFrame([*rows, (None, *good[0][1:])], docs.schema)), sf).select("doc_id", "text").collect()
    assert not {r.text for r in left} & set(junk)
    assert sum((g.doc_id, g.text) in {tuple(r) for r in left} for g in good) >= 8  # the limits move a little with the keys
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) > 20").orderBy("item_id").first().text
    clean = [f"{chr(97 + i)}{j} is a word of its own, number {i * 7 + j}." for i in range(3) for j in range(9)]
    for own in (1, None):
        rows = [(own, item, "en", "s", len(item)), (own, " ".join(clean), "en", "s", 9), (2, "quite another text that is long enough to have words", "en", "s", 9)]
        df = spark.createDataFrame(rows, docs.schema)
        assert {r.text for r in corpus_pipeline.benchmark_passages(spark, df, sf).collect()} == {r[1] for r in rows[1:]}
        copies = spark.createDataFrame([*rows, (0, item, "en", "s", len(item))], docs.schema)
        left = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, copies, sf).collect()}
        assert {(own, rows[1][1]), (2, rows[2][1]), (0, item)} <= left and ((1, item) not in left)


def test_sweep(spark):
    kept = scratch(spark.range(3), "test")
    assert kept.count() == 3 and sweep(spark) > 0 and sweep(spark) == 0


def test_scores_do_not_depend_on_how_spark_splits_the_windows(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 20_000)  # several shards
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({r.doc_id: r.score for r in mixing.score_documents(docs.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
