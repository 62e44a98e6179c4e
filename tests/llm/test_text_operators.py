"""Token counts, packing, training order, sentence spans, byte dedup and tiling against plain versions."""

import hashlib
import random
import time
from collections import Counter
import zlib

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from sql_twin import same_as_sql  # isort: skip

from duelframe.llm import induced, jaccard, packing, sentence_spans, substring_dedup, tiling, token_counts, training_order
from duelframe.llm.common import ChunkEncoder, vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def test_token_counts(spark, sf, odd_docs, no_docs):
    t = Tokenizer.from_file(BYTES)
    for df in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        want = sorted(((i, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts), key=repr)
        got = token_counts.count_tokens(df, BYTES, piece=500, batch_bytes=5000).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    rng = random.Random(4)
    parts = ["漢字", "。", "、", "привет", " ", "\n", "  ", "'s", "don't", "<|endoftext|>", "|", "_", "9", "²", "é", "e\u0301", "\u00a0", "\x1c", "x", "!?", "مرحبا", "\t", "😀"]
    for _ in range(500):  # cut at every place that counts as safe
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        assert int(token_counts._lengths(BYTES, [text], 1, 100)[0]) == len(t.encode(text, add_special_tokens=False).ids)
    assert len(token_counts.safe_pieces("привет мир. " * 20_000, 1000)) > 200 and len(token_counts.safe_pieces("漢字漢字。" * 20_000, 1000)) > 90
    assert token_counts.safe_pieces("x" * 5000, 1000) == ["x" * 5000]
    assert token_counts.count_tokens(no_docs, BYTES).count() == 0


def test_chunk_encoder_is_the_library():
    texts = ["It's <|endoftext|> DON'T  x y ÀÉ Ünï ß İ ΣΑΣ ́b 漢字 1234 a1b2 <|ENDOFTEXT|>", "", "\n\n \t a.b,c;d... !! x?!,", "café's ªº µ  x\x1cy"]
    t = Tokenizer.from_file(WORDS)
    for limit in (3, 1000):
        encode = ChunkEncoder(WORDS, limit=limit)
        for x in texts:
            assert np.frombuffer(encode([x])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing(spark, sf, odd_docs, no_docs):
    t = Tokenizer.from_file(WORDS)
    for df in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        got = packing.pack_documents(df, WORDS).collect()
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
            want += [(r.doc_id, i, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        least = -(-sum(r.length for r in got) // 4096)
        assert len(by) <= 1.1 * least + 2
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_configurations_use_every_piece_and_keep_to_the_bound():
    rng = random.Random(1)
    cases = [{s: rng.randint(1, 50) for s in rng.sample(range(1, 129), 60)} for _ in range(5)]
    cases += [{s: 50 for s in range(1, 129)}, {s: rng.randint(1, 5000) for s in range(30, 70)}, {128: 3, 200: 2}, {43: 1000, 42: 1000, 86: 300}, {}]
    for counts in cases:
        used = {}
        found, bound = packing.configurations(counts, 128)
        for times, n in found:
            assert sum(s * k for s, k in times.items()) <= 128 or list(times) == [200]
            for s, k in times.items():
                used[s] = used.get(s, 0) + k * n
        assert used == counts
        plain = sum(n for _, n in packing.best_fit([], {s: n for s, n in counts.items() if s < 128}, 128)) + sum(n for s, n in counts.items() if s >= 128)
        number = sum(n for _, n in found)
        assert bound - 1e-6 <= number <= plain
    # two of 43 and one of 42, and so on: known optimum
    assert sum(n for _, n in packing.configurations({64: 1000, 32: 2000, 16: 4000}, 128)[0]) == 1500
    fixed = packing.configurations({43: 2000, 42: 1000}, 128)
    assert sum(n for _, n in fixed[0]) == 1000 and abs(fixed[1] - 1000) < 1


def fewest(sizes, capacity):
    """The fewest sequences for some pieces, by trying all ways."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[i]}:
            rest = list(rooms)
            rest.remove(room)
            place(i + 1, [*rest, room - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_packing_against_all_ways():
    rng, worse = random.Random(4), 0
    for _ in range(150):
        capacity = rng.choice([20, 64, 100])
        sizes = [rng.randint(1, capacity) if rng.random() < 0.4 else rng.randint(1, capacity // 2) for _ in range(rng.randint(3, 10))]
        found, bound = packing.configurations(dict(Counter(sizes)), capacity)
        least, number = fewest(sizes, capacity), sum(n for _, n in found)
        assert bound - 1e-6 <= least <= number <= least + 1
        worse += number > least
    assert worse <= 3


def test_packing_wastes_nothing_where_it_need_not(spark, sf):
    cut = packing.pieces(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), WORDS)
    tokens = cut.agg(F.sum("length")).first()[0]
    assert packing.pack(cut).agg(F.max("sequence_id")).first()[0] + 1 == -(-tokens // 4096)


def test_packing_takes_any_limit(spark):
    rows = [(i, n) for i, n in enumerate([4095, 4094, 1, 2, 3, 4000, 95])]
    cut = spark.createDataFrame(rows, "doc_id long, length long").selectExpr("*", "0 AS piece", "0L AS start")
    for limit in (4095, 4097, 4096):
        got = packing.pack(cut, limit=limit).collect()
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(got) == len(rows) and all(sum(n for _, n in v) <= limit for v in by.values())


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(training_order.permute(np.arange(n), n, 7).tolist()) == list(range(n))
    assert training_order.permute(np.arange(100), 100, 1).tolist() != training_order.permute(np.arange(100), 100, 2).tolist()


def test_training_order_round_trip(spark, odd_docs, no_docs, tmp_path):
    path = str(tmp_path / "order")
    n = training_order.write_training_order(odd_docs, path, vocabulary("byte_bpe_50k.tiktoken"), length=64, stride=100)
    rows = training_order.read_training_order(spark, path, stride=100).collect()
    assert sorted(r.slot for r in rows) == list(range(n)) and all(r.shard == r.slot // 100 and len(r.ids) == 128 for r in rows)
    encode = training_order._encoding(vocabulary("byte_bpe_50k.tiktoken")).encode_ordinary
    want = sorted(tuple([*encode(r.text or ""), training_order.END_ID]) for r in odd_docs.select("text").collect())
    pieces = {}
    for r in odd_docs.groupBy("doc_id").count().collect():
        own = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: (x.piece, x.slot))
        if r["count"] == 1:
            pieces[r.doc_id] = tuple(np.concatenate([np.frombuffer(x.ids, "<u2")[: x.n_tokens] for x in own]).tolist())
    assert set(pieces.values()) <= set(want) and len(pieces) == 9
    assert training_order.read_training_order(spark, path, n - 3, 100).count() == 3
    few = str(tmp_path / "few")
    training_order.write_training_order(odd_docs, few, vocabulary("byte_bpe_50k.tiktoken"), length=64, stride=100, most_tasks=2)
    assert sorted(map(tuple, training_order.read_training_order(spark, few, stride=100).collect())) == sorted(map(tuple, rows))
    assert training_order.write_training_order(no_docs, str(tmp_path / "none"), vocabulary("byte_bpe_50k.tiktoken")) == 0


def every_run(rows, min_sentences=2, min_words=16, alone=50):
    seen, out = {}, {}
    for i, text in sorted(rows):
        parts, words = sentence_spans.split(text)
        gone = set()
        for a in range(len(parts)):
            for b in range(a, len(parts)):
                n = sum(map(len, words[a : b + 1]))
                if n >= min_words and b - a + 1 >= min_sentences or a == b and n >= alone:
                    if seen.setdefault(tuple(tuple(w) for w in words[a : b + 1]), (i, a)) != (i, a):
                        gone.update(range(a, b + 1))
        out[i] = (len(parts), len(gone), b"".join(p for k, p in enumerate(parts) if k not in gone))
    return out


def test_sentence_spans(spark, sf, duck, odd_docs, no_docs):
    same_as_sql(duck, sentence_spans.op5_substring_dedup(spark, sf), sentence_spans.OP5_SQL)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000")
    want = every_run([(r.doc_id, r.text.encode()) for r in docs.collect()])
    for r in sentence_spans.drop_repeated_spans(docs).collect():
        assert want[r.doc_id] == (r.n_sentences, r.n_removed, r.text.encode())
    out = sentence_spans.drop_repeated_spans(odd_docs)
    assert out.columns == [*[c for c in odd_docs.columns if c != "n_sentences"], "n_sentences", "n_removed"]
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].text is None and by[3][0].text == "" and by[None][0].text == "a text without an id"
    assert by[9][0].n_removed == 2 and by[1][0].n_removed == 0 and by[6][0].text == "" and by[6][0]["_gone"] == 2
    assert len(by[5]) == 2 and by[5][0].text == by[5][1].text != ""
    assert sentence_spans.drop_repeated_spans(no_docs).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    long = "".join(f"Sentence number {k} of a rather long text that is here for the test, word {k * 7}. " for k in range(30))
    rows = [(1, "Something else entirely."), (2, long), (2, "short one."), (2, None), (3, long), (3, long), (3, "short two.")]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(f"id{i}", t) for i, t in rows], "doc_id string, text string")):
        got = sorted(((str(r.doc_id)[-1], r.n_bytes, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()))
        repeated = [n for i, n, m in got if m == n and n]
        assert len(got) == 7 and ("2", 10, 0) in got and ("2", len(long), 0) in got and repeated == [len(long)] * 2
        got = sorted((str(r.doc_id)[-1], r.text) for r in sentence_spans.drop_repeated_spans(df).select("doc_id", "text").where("text is not null").collect())
        assert got == sorted([("1", rows[0][1]), ("2", long), ("2", "short one."), ("3", ""), ("3", ""), ("3", "short two.")])
        kept = sorted(str(r.doc_id)[-1] + (r.text or "")[:5] for r in jaccard.drop_near_duplicates(df).collect())
        assert kept == ["1Somet", "2", "2Sente", "2short", "3short"]
        links = {(str(r.doc_id)[-1], str(r.class_id)[-1], r.n_links) for r in jaccard.jaccard_links(df).collect()}
        assert ("3", "2", 0) in links and ("1", "1", 0) in links
        found = tiling.decontaminate(df, spark.createDataFrame([("t", long[:500])], "item_id string, text string")).where("contaminated").collect()
        assert sorted(str(r.doc_id)[-1] for r in found) == ["2", "3", "3"]


def test_sentence_spans_of_every_run(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choices("abcdef", k=rng.choice([0, 1, 2, 3, 9, 20]))) + ". " for _ in range(60)]
    rows = [(0, "".join(pool[:20])), (1, "".join(pool[:20]))]
    for i in range(2, 60):
        a = rng.randrange(50)
        rows.append((i, "".join(pool[a : a + rng.randrange(1, 10)] + rng.choices(pool, k=rng.randrange(8)))))
    want = every_run([(i, t.encode()) for i, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text.encode()) for r in sentence_spans.drop_repeated_spans(df).collect()}
    assert got == want and got[1][2] == b""
    tail = [(1, "w " * 9 + "x. " + "y " * 9 + "z. Stub one. Stub two.", "en", "s", 1), (2, "w " * 9 + "x. " + "y " * 9 + "z. Stub one. Stub two. Another end.", "en", "s", 1)]
    docs = spark.createDataFrame(tail, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in corpus_pipeline.repeated_spans(spark, docs, "").collect()} == {1: tail[0][1], 2: "Another end."}


def plain_bytes(rows, size):
    first, out = {}, {}
    for i, text in sorted(rows):
        hit = np.zeros(len(text), bool)
        for k in range(len(text) - size + 1):
            w = text[k : k + size]
            if w in first:
                hit[k : k + size] = True
            else:
                first[w] = k
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out[i] = (len(text), int(hit.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~hit].tobytes()).hexdigest())
    return out


def test_byte_dedup(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = plain_bytes([(r.doc_id, r.text.encode()) for r in docs.collect()], 100)
    got = substring_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    by = {}
    for r in substring_dedup.remove_repeats(odd_docs).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].n_bytes == 0 and by[None][0].n_removed == 0 and by[6][0].n_removed == by[6][0].n_bytes and len(by[5]) == 2
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_byte_dedup_of_random_pieces(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ab c") for _ in range(3000))
    rows = []
    for i in range(60):
        a = rng.randrange(2500)
        rows.append((i, base[a : a + rng.randrange(400)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(120))) + "ab" * rng.randrange(90)))
    want = plain_bytes([(i, t.encode()) for i, t in rows], 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()} == want
    hot = substring_dedup.find_repeats(df, "doc_id", "text", hot=3).groupBy("id").count().collect()
    assert {r.id for r in hot} == {i for i, w in want.items() if w[1]}


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(300):
        t = []
        for _ in range(rng.randint(1, 4)):
            t += [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.choice([0, 3, 20]))] + [0]
        order, lcp = induced.suffix_array(np.array(t), limit=rng.choice([0, 100, 1 << 20]))

        def key(i, t=t):
            out = []
            while t[i]:
                out.append((t[i], 0))
                i += 1
            return [*out, (0, i)]

        want = sorted(range(len(t)), key=key)
        assert order.tolist() == want
        for k in range(1, len(t)):
            n = 0
            while t[want[k] + n] == t[want[k - 1] + n] != 0:
                n += 1
            assert lcp[k] == n
    assert len(induced.suffix_array(np.array([], np.int64))[0]) == 0


def plain_tiles(p, t, least):
    """Greedy string tiling by trying all pairs of places."""
    free_p, free_t, out = [x >= 0 for x in p], [x >= 0 for x in t], 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and free_p[i + n] and free_t[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        free_p[i : i + n] = [False] * n
        free_t[j : j + n] = [False] * n
        out += n


def test_tiles_cover_like_plain_ones():
    rng = random.Random(3)
    for _ in range(200):
        p = np.array([rng.randrange(6) for _ in range(rng.randrange(4, 30))])
        t = np.array([rng.randrange(6) for _ in range(rng.randrange(40))] + p.tolist()[len(p) // 2 :] + [7] + p.tolist()[: len(p) // 2])
        found = tiling.tiles(p, t, 3)
        for i, j, n in found:
            assert n >= 3 and p[i : i + n].tolist() == t[j : j + n].tolist()
        used = [x for i, _, n in found for x in range(i, i + n)]
        assert len(used) == len(set(used))
        assert len(used) == plain_tiles(p.tolist(), t.tolist(), 3)


def plain_decontamination(docs, items, seed=5, threshold=0.5):
    words = tiling.Words()
    held = [(i, words((t or "").encode())) for i, t in items if i is not None]
    out = []
    for i, text in docs:
        t = words((text or "").encode())
        runs = {tuple(t[k : k + seed].tolist()) for k in range(len(t) - seed + 1)}
        share = [(sum(x[2] for x in tiling.tiles(p, t, seed)) / len(p), j) for j, p in held if any(tuple(p[k : k + seed].tolist()) in runs for k in range(len(p) - seed + 1))]
        best = max((s for s, _ in share), default=0.0)
        out.append((i, min((j for s, j in share if s == best), default=None), best, sum(s >= threshold for s, _ in share)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def bench(spark):
    words = [f"w{k}" for k in range(60)]
    return spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[30:])), (3, "too short"), (4, None)], "item_id long, text string")


def test_decontamination(spark, sf, bench, odd_docs, no_docs):
    w = [f"w{k}" for k in range(60)]
    docs = [(1, "x " * 50 + " ".join(w[15:30]) + " y " + " ".join(w[:15]) + " z"), (2, " ".join(w[30:40])), (3, "W30, W31; w32. W33 w34 w35 w36 w37 w38 w39 w40 w41 w42 w43 w44 w45!"), (4, "of and the")]
    got = {r.doc_id: r for r in tiling.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got[1].contaminated and got[1].coverage == 1.0 and got[1].item_id == 1
    assert not got[2].contaminated and round(got[2].coverage, 3) == 0.333
    assert got[3].contaminated and got[3].item_id == 2
    assert not got[4].contaminated and got[4].item_id is None
    texts, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_decontamination([(r.doc_id, r.text) for r in texts.collect()], [(r.item_id, r.text) for r in items.collect()])
    for bits in (1 << 27, 1 << 11):  # a filter that lets nearly everything through changes nothing
        got = [(r.doc_id, r.item_id, r.coverage, r.n_items) for r in tiling.decontaminate(texts, items, filter_bits=bits).collect()]
        assert sorted(got, key=repr) == want and any(r[3] for r in got)
    assert tiling.decontaminate(odd_docs, bench).count() == 11 and tiling.decontaminate(no_docs, bench).count() == 0
    assert tiling.decontaminate(odd_docs, bench.where("false")).where("contaminated").count() == 0


def test_repeated_words_cost_their_ends_alone():
    rng = np.random.default_rng(4)
    for _ in range(60):  # few different words, in runs and in periods
        p, t = (np.concatenate([np.resize(rng.integers(0, 3, rng.integers(1, 4)), rng.integers(1, 12)) for _ in range(4)]).astype(np.int64) for _ in range(2))
        assert sum(x[2] for x in tiling.tiles(p, t, 3)) == plain_tiles(p.tolist(), t.tolist(), 3)
    begin = time.perf_counter()
    assert tiling.tiles(np.full(1000, 7), np.full(100_000, 7), 5) == [(0, 0, 1000)]
    assert time.perf_counter() - begin < 30  # all pairs of places would be 10^8
