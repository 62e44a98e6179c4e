"""Further queries: records, sidecars, selections, accessors, live updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..operators import etl, graph, matrix, pairing, stats, tables, vectors
from .base import Tables, query


_LORA = """CASE steps % 4 WHEN 0 THEN concat('{"Fine Style:1": 0.', CAST(steps % 10 AS STRING), '}') WHEN 1 THEN '["Fine Style:1", ""]' WHEN 2 THEN '"Fine Style:1"' ELSE 'null' END"""
_ENTRY = f"""concat('{{"steps": ', CAST(steps AS STRING), ', "sampler": "', sampler, '", "clip_skip": ', CAST(steps % 3 AS STRING), ', "lora": ', {_LORA}, ', "lora_weight": 0.', CAST(steps % 7 AS STRING),
', "score": 0.4, "(Scale:2)": 1.', CAST(steps % 9 AS STRING), ', "tags": ["a", ["(b:2)", 0.5], "', scheduler, '"]}}')"""


def _entries(t: Tables):
    """Records as JSON text whose fields vary with the row."""
    return t.records.select("id", "score", F.expr(_ENTRY).alias("entry"))


@query("""SELECT id, unnest(list_filter([concat('clip_skip:', CASE WHEN steps % 3 = 0 THEN '-0.0' ELSE concat('-', CAST(steps % 3 AS VARCHAR), '.0') END),
CASE steps % 4 WHEN 0 THEN concat('lora:fine style_0.', CAST(steps % 10 AS VARCHAR)) WHEN 2 THEN concat('lora:fine style_0.', CAST(steps % 7 AS VARCHAR)) END,
concat('sampler:', sampler), concat('steps:', CAST(steps AS VARCHAR)), 'score:0.4', concat('scale:', CAST(CAST(2 + (steps % 9) * 0.2 AS DECIMAL(4, 1)) AS VARCHAR)), 'tags:a', 'tags:b_1.0', concat('tags:', scheduler)], lambda x: x IS NOT NULL)) AS p FROM records""", "records")
def f09_parameter_strings(t: Tables):
    return _entries(t).select("id", F.explode(records.parameter_strings("entry")).alias("p"))


@query("SELECT id, CASE steps % 4 WHEN 0 THEN CAST(concat('0.', CAST(steps % 10 AS VARCHAR)) AS DOUBLE) WHEN 1 THEN 1.0 WHEN 2 THEN CAST(concat('0.', CAST(steps % 7 AS VARCHAR)) AS DOUBLE) END AS w FROM records", "records")
def p13_lora_weights(t: Tables):
    return _entries(t).select("id", F.try_element_at(records.lora_map("entry"), F.lit("Fine Style:1")).alias("w"))


@query("SELECT id, steps FROM records", "records")
def s21_s23_nested_json(t: Tables):
    wrapped = _entries(t).select("id", F.to_json(F.struct(F.col("entry").alias("inner"))).alias("entry"))
    return wrapped.select("id", F.get_json_object(records.unfold_json("entry"), "$.inner.steps").cast("int").alias("steps"))


@query("""SELECT id, CASE WHEN k < 2 THEN sampler END AS sampler, CASE WHEN k < 2 THEN CAST(steps AS VARCHAR) WHEN k = 2 THEN '"kept"' END AS seed, '0.5' AS score, 25.0 / 3 AS rating_sigma, '[]' AS history, 0 AS dropped,
CASE WHEN k = 0 THEN concat('p', CAST(id AS VARCHAR)) WHEN k = 1 THEN concat('q', CAST(id AS VARCHAR)) END AS prompt_tags, CASE WHEN id % 3 > 0 THEN concat(CAST(id AS VARCHAR), '.png') END AS filename, CAST(CASE k WHEN 0 THEN 9 WHEN 1 THEN 9 WHEN 2 THEN 7 ELSE 6 END + CASE WHEN id % 3 > 0 THEN 1 ELSE 0 END AS INT) AS n
FROM (SELECT *, id % 4 AS k FROM records)""", "records")
def p10_clean_sidecar(t: Tables):
    """Sidecars of four kinds: one inner object with a prompt; fields and a prompt below; nothing left but an inner object; no object at all."""
    old = [F.lit(0.7).alias(k) for k in ("score", "score_modifier", "volatility", "confidence", "image", "comparison_count", "rating_mu", "rating_sigma")]
    name, own = F.col("id").cast("string"), [F.col("sampler"), F.col("steps").alias("seed"), F.array(F.lit(1)).alias("comparison_history")]
    kinds = [
        F.to_json(F.struct(F.struct(F.concat(F.lit("p"), name).alias("positive_prompt"), *own, *old).alias("2024-01-01"))),
        F.to_json(F.struct(*own, F.struct(F.struct(F.concat(F.lit("q"), name).alias("positive_prompt")).alias("deep")).alias("inner"), *old)),
        F.to_json(F.struct(F.struct(F.lit("kept").alias("seed"), *old).alias("image"), *old[:4])),
        F.lit("[1, 2]"),
    ]
    e = t.records.select("id", F.element_at(F.array(*kinds), (F.col("id") % 4 + 1).cast("int")).alias("e"), F.when(F.col("id") % 3 > 0, F.concat(name, F.lit(".png"))).alias("f"))
    c = e.select("id", etl.clean_sidecar(F.col("e"), F.col("f")).alias("c"))
    raw = F.from_json("c", "map<string,variant>")
    text = F.when(F.get_json_object("c", "$.seed") == "kept", F.lit('"kept"')).otherwise(F.get_json_object("c", "$.seed"))
    gone = F.size(F.array_intersect(F.json_object_keys("c"), F.array(*[F.lit(x) for x in ("score_modifier", "volatility", "confidence", "image")])))
    got = {k: F.get_json_object("c", f"$.{k}") for k in ("sampler", "score", "prompt_tags", "filename")}
    return c.select("id", got["sampler"].alias("sampler"), text.alias("seed"), got["score"].alias("score"), F.get_json_object("c", "$.rating_sigma").cast("double").alias("rating_sigma"), F.get_json_object("c", "$.comparison_history").alias("history"), gone.alias("dropped"), got["prompt_tags"].alias("prompt_tags"), got["filename"].alias("filename"), F.size(raw).alias("n"))


@query("""SELECT id, CASE WHEN id % 3 < 2 THEN prompt END AS found, id % 3 < 2 AND id % 5 > 0 AS complete FROM prompts""", "prompts")
def p11_p12_sidecar_fields(t: Tables):
    """The prompt at the top, in custom_text, or nowhere; a second required field that some lack."""
    other = F.when(F.col("id") % 5 > 0, F.lit("x"))
    top = F.struct(F.when(F.col("id") % 3 == 0, F.col("prompt")).alias("positive_prompt"), other.alias("model"), F.struct(F.when(F.col("id") % 3 == 1, F.col("prompt")).alias("positive_prompt")).alias("custom_text"))
    e = t.prompts.select("id", F.to_json(top).alias("e"))
    return e.select("id", records.prompt_of("e").alias("found"), etl.has_fields(F.col("e"), ["positive_prompt", "model"]).alias("complete"))


@query("SELECT event_id, event_type AS k, 1.0 AS w FROM events WHERE event_type <> ''")
def f22_as_map(t: Tables):
    return t.events.select("event_id", F.explode(vectors.as_map(F.col("event_type"), "string")).alias("k", "w"))


_PLACE = "((strpos('0123456789abcdef', h[1]) - 1) * 4096 + (strpos('0123456789abcdef', h[2]) - 1) * 256 + (strpos('0123456789abcdef', h[3]) - 1) * 16 + strpos('0123456789abcdef', h[4]) - 1) % 32"


@query(f"""WITH w AS (SELECT id, md5(unnest(list_filter(regexp_split_to_array(lower(name), '\\W+'), lambda x: x <> ''))) AS h FROM (SELECT p_partkey AS id, p_name AS name FROM part)),
p AS (SELECT id, {_PLACE} AS i, sum(CASE WHEN h[5] < '8' THEN 1.0 ELSE -1.0 END) AS s FROM w GROUP BY ALL), n AS (SELECT id, greatest(sqrt(sum(s * s)), 1e-12) AS norm FROM p GROUP BY id)
SELECT id, CAST(i AS INT) AS i, round(s / norm, 9) AS v FROM p JOIN n USING (id) WHERE s <> 0""")
def v07_text_embedding(t: Tables):
    """Every place of the stand-in embedding that isn't 0."""
    v = t.part.select(F.col("p_partkey").alias("id"), F.posexplode(records.hashed_embedding(F.col("p_name"), 32)).alias("i", "v"))
    return v.where("v <> 0").select("id", "i", F.round("v", 9).alias("v"))


@query("SELECT id, max(CASE WHEN vector_name = 'size' THEN v END) AS size, max(CASE WHEN vector_name = 'price' THEN v END) AS price FROM slots GROUP BY id", "slots")
def v10_text_record(t: Tables):
    return t.slots.groupBy("id").pivot("vector_name", ["size", "price"]).agg(F.max("v"))


@query("SELECT round(score, 3) AS three, count(*) AS n FROM records GROUP BY 1", "records")
def p18_rounding(t: Tables):
    return t.records.groupBy(F.round("score", 3).alias("three")).agg(F.count("*").alias("n"))


_ODD = "CASE WHEN steps % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN steps % 11 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN steps % 13 = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN steps % 17 = 0 THEN NULL ELSE cfg END"


@query("SELECT id FROM records WHERE steps % 7 <> 0 AND steps % 11 <> 0 AND steps % 13 <> 0 AND steps % 17 <> 0", "records")
def p15_finite(t: Tables):
    odd = t.records.withColumn("x", F.expr(_ODD))
    return odd.where(stats.finite("score") & stats.finite("x")).select("id")


@query("SELECT scheduler, avg(score) AS mean, stddev_pop(score) AS std, count(*) AS n FROM records GROUP BY scheduler", "records")
def a21_categories(t: Tables):
    return stats.category_stats(t.records, "scheduler")


@query("(SELECT filename, score, 'top' AS side FROM images ORDER BY score DESC, filename LIMIT 10) UNION ALL (SELECT filename, score, 'bottom' FROM images ORDER BY score, filename LIMIT 10)", "images")
def o03_top_bottom(t: Tables):
    return matrix.extremes(t.images.select("filename", "score"), "score", 10, "filename")


@query("SELECT filename FROM images ORDER BY filename LIMIT 25", "images")
def o06_first_files(t: Tables):
    return t.images.select("filename").orderBy("filename").limit(25)


@query("SELECT filename FROM images ORDER BY md5(concat(filename, ':947')), filename LIMIT 40", "images")
def o12_sample(t: Tables):
    """A sample without replacement, the same in every run: the least digests of a seed."""
    return t.images.orderBy(F.md5(F.concat("filename", F.lit(":947"))), "filename").limit(40).select("filename")


@query("SELECT DISTINCT id FROM slots", "slots")
def u06_distinct_ids(t: Tables):
    return t.slots.select("id").distinct()


@query("""SELECT filename, CASE WHEN strpos(prompt_tags, 'ring') > 0 AND strpos(prompt_tags, 'small') > 0 THEN 0 ELSE 1 END AS block FROM images
WHERE strpos(prompt_tags, 'ring') > 0 OR strpos(prompt_tags, 'small') > 0""", "images")
def u08_blocks(t: Tables):
    from ..operators.gallery import tagged

    return tagged(t.images, ["ring", "small"], "both").select("filename", "block")


@query("SELECT CAST(row_number() OVER () - 1 AS INT) AS number, phase FROM (SELECT unnest(['seed_coverage', 'anchor_insert', 'collapsible', 'single_win_loss', 'chain_merge', 'uncertainty', 'fallback']) AS phase)")
def q11_phases(t: Tables):
    return t.spark.createDataFrame(list(enumerate(pairing.PHASES)), "number int, phase string")


@query("""WITH l AS (SELECT filename_a, filename_b, id FROM comparisons WHERE filename_a <> filename_b), s AS (SELECT filename, rating_mu - 3 * rating_sigma AS skill FROM images),
g AS (SELECT l.id, abs(a.skill - b.skill) AS gap FROM l JOIN s a ON a.filename = l.filename_a JOIN s b ON b.filename = l.filename_b)
SELECT max(gap) AS widest, min(gap) AS closest FROM g""", "images")
def o07_score_gaps(t: Tables):
    s = pairing.candidates(t.images).select("filename", "skill")
    c = t.comparisons.where("filename_a <> filename_b")
    j = c.join(s.select(F.col("filename").alias("filename_a"), F.col("skill").alias("sa")), "filename_a").join(s.select(F.col("filename").alias("filename_b"), F.col("skill").alias("sb")), "filename_b")
    return j.agg(F.max(F.abs(F.col("sa") - F.col("sb"))).alias("widest"), F.min(F.abs(F.col("sa") - F.col("sb"))).alias("closest"))


@query("""SELECT i.filename, coalesce(c.n, 0) AS n FROM images i LEFT JOIN (SELECT f, count(*) AS n FROM (SELECT filename_a AS f FROM comparisons UNION ALL SELECT filename_b FROM comparisons) GROUP BY f) c ON c.f = i.filename""", "images")
def j10_nodes_with_counts(t: Tables):
    n = stats.comparison_counts(t.comparisons)
    return t.images.select("filename").join(n, "filename", "left").select("filename", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT id FROM comparisons WHERE id % 13 = 0", "comparisons")
def p02_invalid_winners(t: Tables):
    """A thirteenth of the comparisons gets a winner that took no part."""
    c = t.comparisons.withColumn("winner", F.when(F.col("id") % 13 == 0, F.lit("img_none")).otherwise(F.col("winner")))
    return c.select("id").join(tables.valid_winner(c).select("id"), "id", "left_anti")


@query()
def m07_m08_interaction_selection(t: Tables):
    """The interaction features with the best F scores, applied."""
    x = F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double"))
    df = t.embeddings.select("vec_id", x.alias("v"), (F.col("label") / 10).alias("y"))
    p = df.select("vec_id", "y", vectors.interactions(F.col("v")).alias("p"), "v")
    names = [f"p{i}" for i in range(15)]
    wide = p.select("vec_id", "y", "v", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    best = [r.idx for r in stats.correlation_scores(wide, names, "y", 5).collect()]
    return p.select("vec_id", F.concat("v", vectors.gather(F.col("p"), best)).alias("features"))
