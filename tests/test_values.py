"""Terms, vectors, images, calibration, settings search, files and pair choice."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.functions import arrays, images, rating_math, records, terms
from duelframe.operators import calibration, etl, gallery, live, pairing, training, vectors
from duelframe.sources import files


@pytest.mark.parametrize(("text", "want"), [
    ("(red, blue:1.5)", [("red", 1.5, 0), ("blue", 1.5, 1)]),
    ("red car, (blue sky)", [("red car", 1.0, 0), ("blue sky", 1.1, 1)]),
    ("((deep))", [("deep", 1.1 * 1.1, 0)]),
    ("sun but moon not stars", [("sun", 1.0, 0), ("moon", 1.0, 1), ("stars", 1.0, 2)]),
    ("butter, nothing", [("butter", 1.0, 0), ("nothing", 1.0, 1)]),
    ("a, the, tree", [("tree", 1.0, 2)]),
    ("sky, (sky:1.4), sky", [("sky", 1.4, 1)]),
    ("", []), (None, []), ("(((", []),
])
def test_extract(text, want):
    got = terms.extract(text)["terms"]
    assert [(t, i) for t, _, i in got] == [(t, i) for t, _, i in want]
    assert [w for _, w, _ in got] == pytest.approx([w for _, w, _ in want])


def test_extract_keeps_what_it_drops():
    e = terms.extract("sky, (sky:1.4), a, ...")
    assert e["duplicates"] == [("sky", 1.0, 0)] and e["filtered_out"] == [("a", 1.0, 2)] and e["stripped"] == [("", 1.0, 3)]


def test_term_columns_are_the_functions(spark):
    rows = ["[brackets]!", " a  b\\c|d:1.5 ", "(x : 1.5)", "(no_colon)", "plain", "Tag: 2"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    got = df.select("t", terms.clean_column(F.col("t")).alias("c"), terms.weight_columns(F.col("t"))[0].alias("x"), terms.weight_columns(F.col("t"))[1].alias("w")).collect()
    for r in got:
        assert r.c == terms.clean(r.t) and (r.x, r.w) == terms.paren_weight(r.t)


def test_term_table(spark):
    spark.udtf.register("terms", terms.TermTable)
    got = spark.sql("SELECT p.id, t.term, t.weight FROM VALUES (1, 'red, (blue:2)') AS p(id, prompt), LATERAL terms(p.prompt) t").collect()
    assert {(r.term, r.weight) for r in got} == {("red", 1.0), ("blue", 2.0)}


def test_slots(spark):
    e = spark.createDataFrame([(1, 5.0, {"a": 0.5, "q": 9.0}, [{"a": 1.0}, {"b": 2.0}], [3.0, 4.0]), (2, None, None, None, None)], "id int, n double, m map<string,double>, p array<map<string,double>>, e array<double>")
    slots = [vectors.Slot("n", "number", 1, most=4), vectors.Slot("m", "map", 3, categories=("a", "b")), vectors.Slot("p", "person_map", 5, categories=("a", "b")), vectors.Slot("e", "embedding", 2)]
    got = {r.id: list(r.vector) for r in vectors.vectorise(e, "id", slots).collect()}
    assert got[1] == pytest.approx([4, 0.5, 0, 0, 1, 0, 0, 2, 0, 0.6, 0.8]) and got[2] == [0.0] * 11
    assert len(vectors.layout(slots)) == 11
    with pytest.raises(Exception, match="exceeds"):
        vectors.vectorise(e, "id", [vectors.Slot("e", "embedding", 1)]).collect()


def test_maps(spark):
    df = spark.createDataFrame([("x", ["a", "", "a", "b"])], "s string, l array<string>")
    r = df.select(vectors.as_map(F.col("s"), "string").alias("s"), vectors.as_map(F.col("l"), "array<string>").alias("l")).first()
    assert r.s == {"x": 1.0} and r.l == {"a": 1.0, "b": 1.0}


def test_made_pictures_are_measured_where_they_are_made(spark):
    """As of the same arrays; only what is asked for, and no picture put together as text."""
    df = spark.createDataFrame([(3,), (None,)], "k long")
    out = df.select(images.measure_made(F.col("k"), 130, 140, *[lambda k, x, y: k * 7 + x * y] * 3, only=("contrast", "sharpness")).alias("m"))
    assert not any(x in out._jdf.queryExecution().optimizedPlan().toString() for x in ("transform(", "sequence(", "unhex("))
    y, x = np.indices((130, 140))
    want = images.measures(np.repeat(((21 + x * y) % 256)[:, :, None], 3, axis=2))
    got = out.collect()
    assert got[1].m is None and got[0].m == {k: pytest.approx(want[k]) for k in ("contrast", "sharpness")}


def test_image_measures(spark):
    rng = np.random.default_rng(1)
    flat, noise = np.full((130, 140, 3), 90, np.uint8), rng.integers(0, 256, (130, 140, 3)).astype(np.uint8)
    a, b = images.measures(flat), images.measures(noise)
    assert set(a) == set(images.MEASURES) and a["contrast"] == pytest.approx(0) and a["sharpness"] == a["edge_density"] == a["noise_score"] == a["artifact_score"] == 0
    assert a["final_aspect_ratio"] == a["original_aspect_ratio"] == round(140 / 130, 4) and (a["final_width"], a["original_height"]) == (140, 130)
    assert b["sharpness"] > 0.9 and b["texture_lbp"] > a["texture_lbp"] and b["artifact_score"] == 1 and 2 < b["noise_score"] < 3.5
    red = np.zeros((130, 130, 3))
    red[..., 0] = 255
    assert images.measures(red)["colorfulness"] == pytest.approx(0.3 / 1.3)  # no spread, the mean alone
    assert images.grey_levels(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]])).tolist() == [[76, 150, 29, 255]]
    known = images.measures(noise, {"width": 1000, "height": 500, "aspect_ratio": 2.0, "sharpness": 0.125})
    assert (known["original_width"], known["original_height"], known["original_aspect_ratio"], known["sharpness"], known["final_width"]) == (1000, 500, 2.0, 0.125, 140)
    assert images.measures(np.zeros((100, 200, 3)), dict.fromkeys(images.SIZES, 7.0))["final_width"] == 7
    # one bright line in the dark: each pixel by hand
    line = np.zeros((128, 128, 3))
    line[:, 4] = 255
    m, v = images.measures(line), 255**2 * 6 / 128
    assert m["edge_density"] == pytest.approx(2 / 128) and m["artifact_score"] == pytest.approx(2.5 * 2 / 31) and m["sharpness"] == pytest.approx(v / (v + 500))
    assert images.coerce(np.zeros((3, 200, 201))).shape == (200, 201, 3) and images.coerce(np.zeros((200, 201))).shape == (200, 201, 3)
    with pytest.raises(ValueError, match="small"):
        images.measures(np.zeros((100, 200, 3)))
    df = spark.createDataFrame([(bytearray(noise.tobytes()), 130, 140), (None, 130, 140)], "p binary, h int, w int")
    got = df.select(images.measure("p", "h", "w").alias("m")).collect()
    assert got[0].m == pytest.approx(b) and got[1].m is None


def test_closest_pair_follows_the_node_chosen_so_far(spark):
    rows = [(1, "a", "b", 1.0, 2.0), (2, "c", "d", 3.0, 10.0)]
    schema = "place int, a string, b string, gap double, sigma double"
    assert pairing.closest_pair(spark.createDataFrame(rows, schema)).first().a == "a"  # 3 exceeds the deviation of a
    rows = [(1, "a", "b", 1.0, 3.0), (2, "c", "d", 3.0, 10.0), (3, "e", "f", 9.0, 1.0), (4, "g", "h", 9.5, 99.0)]
    assert pairing.closest_pair(spark.createDataFrame(rows, schema)).first().a == "e"  # e's own deviation ends the walk
    assert pairing.closest_pair(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="more than"):
        pairing.closest_pair(spark.createDataFrame(rows, schema), 3).collect()


def test_vocabulary_overflow_is_an_error(spark):
    df = spark.createDataFrame([({"a": 1.0, " b ": 1.0},), ({"c": 1.0, "a": 1.0, "unknown": 1.0, " ": 1.0},)], "m map<string, double>")
    assert [(r.category, r.idx) for r in vectors.vocabulary(df, "m", 3).collect()] == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(Exception, match="more than 2"):
        vectors.vocabulary(df, "m", 2).collect()


def test_split_store_checks_its_widths(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, [1.0, 2.0]), ("s", 2, [1.0])], "vector_name string, id long, vector array<double>")
    with pytest.raises(Exception, match="length 1, not 2"):
        files.write_split(df, str(tmp_path / "x"), {"s": 2})
    files.write_split(df.where("id = 1"), str(tmp_path / "y"), {"s": 2})
    assert spark.read.parquet(str(tmp_path / "y")).count() == 1


def test_second_alias_and_custom_text(spark):
    e = spark.createDataFrame([(1, None, 7.0, {"a3": 1.0}), (2, 5.0, 7.0, {"a1": 1.0}), (3, None, None, {"a3": 2.0}), (4, None, None, None)], "id long, a1 double, a2 double, custom_text map<string, double>")
    v = vectors.vectorise(e, "id", [vectors.Slot("x", "number", 1, alias=("a1", "a2", "a3"))])
    assert {r.id: r.vector[0] for r in v.collect()} == {1: 7.0, 2: 5.0, 3: 2.0, 4: 0.0}


def test_calibration(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    df = spark.createDataFrame([(float(v), float(1 / (1 + np.exp(-2 * v)))) for v in x], "raw double, target double")
    t = calibration.build(df, "raw", "target")
    assert (np.diff(t["raw_quantiles"]) > 0).all() and (np.diff(t["target_quantiles"]) >= 0).all()
    got = df.select("raw", "target", calibration.apply(F.col("raw"), t).alias("c")).collect()
    p = np.interp([r.raw for r in got], t["raw_quantiles"], t["probabilities"])
    assert np.allclose([r.c for r in got], np.interp(p, t["probabilities"], t["target_quantiles"]))
    assert max(abs(r.c - r.target) for r in got) < 0.02
    assert calibration.build(df.where("false"), "raw", "target") is None
    assert calibration.rising(np.array([1.0, 1.0, 0.5])).tolist() == sorted(set(calibration.rising(np.array([1.0, 1.0, 0.5])).tolist()))


def test_search_improves():
    calls = []

    def value(s):
        calls.append(s.key())
        return -abs(s.max_depth - 4) - abs(s.max_iter - 20) / 10 - abs(s.step_size - 0.1) * 10

    search = training.Search(value, random.Random(1))
    best = search.run(4)
    assert best.score > -2.5 and len(calls) == len(set(calls)) and len(search.top) == 5
    assert all(sum(getattr(n, k) != getattr(best, k) for k in training.GRID) <= 1 for n in training.neighbours(best))


def test_pages():
    assert gallery.page_bounds(1, 20) == (0, 20) and gallery.page_bounds(3, 500) == (40, 20) and gallery.page_bounds(-1, 10) == (0, 10)


def test_widest_gap_within_reach(spark):
    df = spark.createDataFrame([("a", "b", 1.0, 3.0), ("a", "c", 2.5, 3.0), ("a", "d", 4.0, 3.0)], "a string, b string, gap double, sigma double")
    assert pairing.widest_within(df).first().b == "c"
    assert pairing.widest_within(df.where("gap > 3")).first().b == "d"


def test_next_pair_is_new(spark):
    rows = [(f"i{k:03d}", 0.5, 25.0 + k / 10, 8.0, k % 3) for k in range(60)]
    i = spark.createDataFrame(rows, "filename string, score double, rating_mu double, rating_sigma double, comparison_count int")
    c = spark.createDataFrame([(1, "i000", "i001", "i000")], "id long, filename_a string, filename_b string, winner string")
    for start in pairing.PHASES:
        r = pairing.next_pair(i, c, None, start).collect()
        assert len(r) == 1 and r[0].a != r[0].b and {r[0].a, r[0].b} != {"i000", "i001"}


def test_chain_merge_goes_on_past_pairs_on_a_common_path(spark):
    names = [f"b{k:03d}" for k in range(300)]
    rows = [("x", 0.5, 25.0, 8.0, 5)] + [(n, 0.5, 25.0, 8.0, 1) for n in names]
    i = spark.createDataFrame(rows, "filename string, score double, rating_mu double, rating_sigma double, comparison_count int")
    chain = spark.createDataFrame([("x", "c", ["x"], 1, ["x"])] + [("x", f"c{n}", [n, "y"], 2, [n]) for n in names], "component string, chain_id string, nodes array<string>, length long, owners array<string>")
    edges = spark.createDataFrame([("x", n) for n in names[1:]], "winner string, loser string")
    labels = spark.createDataFrame([("x", "x")], "node string, component string")
    cand = pairing.candidates(i)
    assert [tuple(r) for r in pairing.chain_merge(cand, chain, edges, labels).collect()] == [("x", "b000", "chain_merge")]
    more = edges.union(spark.createDataFrame([("x", "b000")], edges.schema))
    assert pairing.chain_merge(cand, chain, more, labels).count() == 0


def test_sidecars(spark, tmp_path):
    d = tmp_path / "tree" / "sub"
    d.mkdir(parents=True)
    (d / "a.json").write_text('{"2024": {"score": 0.7, "custom_text": {"x": 1}}}')
    (d / "b.json").write_text('{"positive_prompt": "sky"}')
    (d / "b.png").write_bytes(b"p")
    got = {r.path.rsplit("/", 1)[1]: r.entry for r in files.read_sidecars(spark, str(tmp_path / "tree")).collect()}
    assert got["a.json"].startswith('{"score"') and "sky" in got["b.json"]
    assert files.read_sidecars(spark, str(tmp_path / "tree"), True).count() == 1
    pairs = etl.paired(files.list_files(spark, str(tmp_path / "tree"))).collect()
    assert {(r.stem, r.image is not None, r.sidecar is not None) for r in pairs} == {("a", False, True), ("b", True, True)}
    df = spark.createDataFrame([(v,) for v in got.values()], "e string")
    assert {r[0] for r in df.select(records.prompt_of("e")).collect()} == {None, "sky"}
    assert sorted(r[0] for r in df.select(etl.has_fields(F.col("e"), ["score", "x"])).collect()) == [False, True]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(p), "a int").collect()) == [1, 2]
    p.write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|invalid|parse"):
        files.read_jsonl(spark, str(p), "a int").collect()


def test_records(spark):
    record = {"lora": "My Lora:0.5", "lora_weight": 0.333, "(Steps:2)": 1.5, "clip_skip": 2, "tags": ["a", 0.5, ["(B:2)", 0.25]], "none": None, "empty": ""}
    assert records.record_parameters(record) == ["lora:my lora_0.33", "steps:3.0", "clip_skip:-2.0", "tags:a", "tags:0.5", "tags:b_0.5"]
    assert records.unfolded({"a": '{"b": "[1, 2]"}', "c": "x"}) == {"a": {"b": [1, 2]}, "c": "x"}
    df = spark.createDataFrame([('{"lora": ["x", ""]}',), ("no json",), (None,), ("[1]",)], "e string")
    got = df.select(records.lora_map("e").alias("m"), records.parameter_strings("e").alias("p"), records.unfold_json("e").alias("u")).collect()
    assert [r.m for r in got] == [{"x": 1.0}, None, None, None] and [r.p for r in got] == [[], [], None, []] and got[1].u is None
    v = spark.createDataFrame([("red fox",), ("",), (None,)], "t string").select(records.hashed_embedding(F.col("t"), 16).alias("v")).collect()
    assert sum(x * x for x in v[0].v) == pytest.approx(1) and v[1].v == v[2].v == [0.0] * 16


def test_odd_records_do_not_fail():
    assert records.labelled("size:big") == ("size", 1.0) and records.labelled("(Size:1.5)") == ("size", 1.5) and records.labelled("a:b:2") == ("a", 2.0)
    assert records.unfolded({"p": "{red|blue} sky}", "q": "{red|blue}", "r": '{"a": "[1]"}'}) == {"p": "{red|blue} sky}", "q": "{red|blue}", "r": {"a": [1]}}


def test_array_expressions(spark):
    rows = [([1.0, 2.0, -1.0],), ([0.5],), ([700.0, 701.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    for r in df.select("v", arrays.softmax(F.col("v")).alias("s"), arrays.l2_normalised(F.col("v")).alias("n"), vectors.interactions(F.col("v")).alias("p")).collect():
        e = np.exp(np.array(r.v) - max(r.v))
        assert r.s == pytest.approx(e / e.sum()) and r.n == pytest.approx(np.array(r.v) / np.linalg.norm(r.v))
        assert r.p == [x * y for i, x in enumerate(r.v) for y in r.v[i + 1 :]]


def test_record(spark):
    i = spark.createDataFrame([("a", 0.5, 25.0, 8.0, 3, None), ("b", 0.5, 20.0, 5.0, 0, None), ("c", 0.5, 25.0, 8.0, 1, None)], "filename string, score double, rating_mu double, rating_sigma double, comparison_count int, last_compared_at string")
    c = spark.createDataFrame([(7, "a", "c", "a", "t", 1.0, 0)], "id long, filename_a string, filename_b string, winner string, timestamp string, weight double, transitive_depth int")
    labels = spark.createDataFrame([("a", "a"), ("c", "a")], "node string, component string")

    def new(*row):
        return spark.createDataFrame([row], "filename_a string, filename_b string, winner string, timestamp string, weight double, transitive_depth int")

    done = live.record(i, c, new("b", "a", "b", "now", 1.0, 0), labels)
    (mw, sw), (ml, sl) = rating_math.update((20.0, 5.0), (25.0, 8.0))
    got = {r.filename: r for r in done.images.collect()}
    assert (got["b"].rating_mu, got["b"].rating_sigma, got["a"].rating_mu, got["a"].rating_sigma) == pytest.approx((mw, sw, ml, sl))
    assert (got["a"].comparison_count, got["b"].comparison_count, got["c"].comparison_count, got["b"].last_compared_at, got["c"].last_compared_at) == (4, 1, 1, "now", None)
    assert sorted((r.id, r.filename_a, r.filename_b, r.winner) for r in done.comparisons.collect()) == [(7, "a", "c", "a"), (8, "a", "b", "b")]
    assert {r.filename for r in done.sync.collect()} == {"a", "b"} and {r.node: r.component for r in done.labels.collect()} == {"a": "a", "b": "a", "c": "a"}
    for bad in (("a", "b", "x", "now", 1.0, 0), ("a", "a", "a", "now", 1.0, 0), ("a", "nobody", "a", "now", 1.0, 0)):
        same = live.record(i, c, new(*bad))
        assert same.comparisons.count() == 1 and same.sync.count() == 0 and sorted(map(str, same.images.collect())) == sorted(map(str, i.collect()))


def test_choice_remembers_its_phase(spark):
    i = spark.createDataFrame([(f"i{k:03d}", 0.5, 25.0 + k / 10, 2.0, 20) for k in range(12)], "filename string, score double, rating_mu double, rating_sigma double, comparison_count int")
    c = spark.createDataFrame([(n, "i000", f"i{n % 11 + 1:03d}", "i000") for n in range(31)], "id long, filename_a string, filename_b string, winner string")
    found, skip = pairing.choose(i, c, skip=6)
    assert found.first().phase == "fallback" and skip == 6
    found, skip = pairing.choose(i, c.limit(30), skip=6)  # a multiple of the reserve count: from the start
    assert pairing.PHASES[skip] == found.first().phase


def test_cumulative(spark):
    from duelframe.operators import stats

    rng = random.Random(8)
    rows = [(float(x), rng.randrange(9)) for x in rng.sample(range(100_000), 700)]
    got = {r.x: r.upto for r in stats.cumulative(spark.createDataFrame(rows, "x double, n long"), "x", "n", cuts=7).collect()}
    total = 0
    for x, n in sorted(rows):
        total += n
        assert got[x] == total
    assert stats.cumulative(spark.createDataFrame([], "x double, n long"), "x", "n").count() == 0


def test_quantiles_by_counting(spark):
    """Ties, wide ranges, few values, neighbouring doubles, nulls and what isn't finite, against numpy."""
    rng = np.random.default_rng(7)
    cases = [rng.normal(size=3000), np.exp(rng.normal(0, 40, 2000)), -np.exp(rng.normal(0, 9, 500)), np.array([3.5]), np.array([1.0, 1.0 + 2**-52, 1.0 + 2**-51, 9.0, -1.7e308, 1.7e308, 0.0, -0.5])]
    cases.append(np.concatenate([np.full(5000, 0.25), rng.random(300) * 1e-9, [1e9]]))
    for x in cases:
        rows = [(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)]
        df = spark.createDataFrame(rows, "x double").repartition(3)
        ordered = sorted(x.tolist())
        assert calibration.order_values(df, "x", [0, len(x) // 3, len(x) - 1, len(x), -1]) == {r: ordered[r] for r in {0, len(x) // 3, len(x) - 1}}
    df = spark.createDataFrame([(float(v),) for v in cases[0]], "x double")
    assert calibration.quantiles(df, "x", 257) == pytest.approx(np.quantile(cases[0], np.linspace(0, 1, 257)), rel=1e-12, abs=1e-12)
    assert calibration.quantiles(df.where("false"), "x").size == 0


def test_links_of_one_image_leave_the_unseen(spark):
    """unseen for pairs of one image, whichever end of a link it is."""
    links = spark.createDataFrame([("a", "m"), ("m", "x"), ("b", "c")], "filename_a string, filename_b string")
    pairs = spark.createDataFrame([("m", x, 1.0) for x in "abcx"], "a string, b string, gap double")
    one = spark.createDataFrame([("m", 0)], "filename string, n int")
    assert sorted(r.b for r in pairing._unseen_by(one, pairs, links).collect()) == sorted(r.b for r in pairing.unseen(pairs, links).collect()) == ["b", "c"]
