"""Queries of statistics, co-occurrence, vectors and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rating_math, terms
from ..operators import calibration, matrix, stats, training, vectors
from .base import Tables, query
from .network import cdf_sql

_SIDES = "SELECT filename_a AS filename FROM comparisons UNION ALL SELECT filename_b FROM comparisons"


@query(f"SELECT filename, count(*) AS n FROM ({_SIDES}) GROUP BY filename", "comparisons")
def a01_comparison_counts(t: Tables):
    return stats.comparison_counts(t.comparisons)


@query(f"""WITH ok AS (SELECT filename FROM ({_SIDES}) GROUP BY filename HAVING count(*) >= 46)
SELECT * FROM comparisons WHERE filename_a IN (SELECT filename FROM ok) AND filename_b IN (SELECT filename FROM ok)""", "comparisons")
def a02_degree_filter(t: Tables):
    return stats.degree_filter(t.comparisons, 46)


@query("SELECT count(score) AS n, min(score) AS min, max(score) AS max, avg(score) AS mean FROM images", "images")
def a04_summary(t: Tables):
    return stats.summary(t.images)


@query("""WITH e AS (SELECT min(rating_mu) AS mn, max(rating_mu) AS mx FROM images)
SELECT CAST(b AS INT) AS bin, mn + b * ((mx - mn) / 10) AS low, mn + (b + 1) * ((mx - mn) / 10) AS high, n FROM (
  SELECT least(floor((rating_mu - mn) / ((mx - mn) / 10)), 9) AS b, mn, mx, count(*) AS n FROM images, e GROUP BY ALL)""", "images")
def a05_histogram(t: Tables):
    return stats.histogram(t.images, "rating_mu", 10)


@query("SELECT CAST(CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 WHEN value < 50 THEN 2 ELSE 3 END AS INT) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def a06_threshold_buckets(t: Tables):
    return stats.threshold_buckets(t.events, "value", [5, 20, 50])


@query("""WITH w AS (SELECT winner AS filename, count(DISTINCT filename_b) AS k FROM dag GROUP BY 1), l AS (SELECT filename_b AS filename, count(DISTINCT filename_a) AS k FROM dag GROUP BY 1)
SELECT count(*) FILTER (WHERE rating_sigma >= 3) AS sigma_above, count(*) FILTER (WHERE rating_sigma < 3) AS sigma_below, count(*) FILTER (WHERE w.k = 1) AS single_win,
count(*) FILTER (WHERE l.k = 1) AS single_loss, count(*) FILTER (WHERE comparison_count >= 10) AS ready FROM images LEFT JOIN w USING (filename) LEFT JOIN l USING (filename)""", "images", "dag")
def a07_readiness(t: Tables):
    return stats.readiness(t.images, t.dag)


@query("SELECT comparison_count, count(*) AS n FROM images GROUP BY 1", "images")
def a07_levels(t: Tables):
    return stats.levels(t.images)


@query("""SELECT m AS level, count(*) FILTER (WHERE comparison_count = m) AS at_level, count(*) FILTER (WHERE comparison_count = m + 1) AS at_next
FROM images, (SELECT min(comparison_count) AS m FROM images) GROUP BY m""", "images")
def a08_level_progress(t: Tables):
    return stats.level_progress(t.images)


@query("SELECT count(*) FILTER (WHERE comparison_count > 0) AS ranked, count(*) FILTER (WHERE comparison_count = 0) AS unranked, count(*) AS total FROM images", "images")
def a09_status(t: Tables):
    return stats.status(t.images)


_PARAMS = """WITH p AS (SELECT score, list_sort(['sampler:' || lower(sampler), 'scheduler:' || lower(scheduler), 'steps:' || CAST(steps AS VARCHAR)]) AS ps FROM records),
c AS (SELECT ps[i] AS p1, ps[j] AS p2, score FROM p, unnest([1, 2, 3]) a(i), unnest([1, 2, 3]) b(j) WHERE j >= i),
modes AS (SELECT p1, p2, arg_max(score, (n, -score)) AS mode FROM (SELECT p1, p2, score, count(*) AS n FROM c GROUP BY ALL) GROUP BY p1, p2),
s AS (SELECT p1, p2, any_value(mode) AS mode, count(*) AS n, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS std, min(score) AS min, max(score) AS max,
quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3 FROM c JOIN modes USING (p1, p2) GROUP BY p1, p2 HAVING count(*) >= 100) """
_COLUMNS = ["sampler", "scheduler", "steps"]


def _cells(t: Tables):
    return matrix.cells(matrix.parameters(t.records, _COLUMNS))


@query(_PARAMS + "SELECT *, q3 - q1 AS iqr, CASE WHEN mean <> 0 THEN std / mean ELSE 99.9 END AS cv, max - min AS range FROM s", "records")
def a11_cell_statistics(t: Tables):
    return matrix.cell_stats(_cells(t))


@query("SELECT sampler, mode AS m FROM (SELECT sampler, arg_max(steps, (n, -steps)) AS mode FROM (SELECT sampler, steps, count(*) AS n FROM records GROUP BY ALL) GROUP BY sampler)", "records")
def a11_mode_lowest(t: Tables):
    return t.records.groupBy("sampler").agg(F.mode("steps", True).alias("m"))


@query(_PARAMS + "SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS entries, avg(mean) AS mean_of_means FROM s", "records")
def a12_matrix_summary(t: Tables):
    return matrix.matrix_summary(matrix.cell_stats(_cells(t)))


@query(_PARAMS + "SELECT p1, p2, count(*) AS n FROM c GROUP BY ALL", "records")
def j18_parameter_pairs(t: Tables):
    return _cells(t).groupBy("p1", "p2").agg(F.count("*").alias("n"))


@query(_PARAMS + "SELECT p1, p2, n, mean FROM s ORDER BY mean DESC, p1, p2 LIMIT 10", "records")
def o05_top_cells(t: Tables):
    return matrix.top_cells(matrix.cell_stats(_cells(t))).select("p1", "p2", "n", "mean")


@query(_PARAMS + "SELECT p1, p2, n FROM s UNION ALL SELECT p2, p1, n FROM s WHERE p1 <> p2", "records")
def s32_mirrored_matrix(t: Tables):
    return matrix.mirrored(matrix.cell_stats(_cells(t))).select("p1", "p2", "n")


@query(_PARAMS + "SELECT count(DISTINCT p1) AS size FROM (SELECT p1 FROM c WHERE p1 = p2)", "records")
def a39_dimensions(t: Tables):
    return matrix.dimensions(matrix.parameters(t.records, _COLUMNS))


_TERMS = """WITH x AS (SELECT id, lower(substr(split_part(prompt, ':1.', 1), 2)) AS a, CAST('1.' || split_part(split_part(prompt, ':1.', 2), ')', 1) AS DOUBLE) AS w,
lower(split_part(split_part(prompt, '), ', 2), ' but ', 1)) AS b, lower(split_part(prompt, ' but ', 2)) AS c FROM prompts),
terms AS (SELECT id, a AS term, w AS weight, CAST(0 AS INT) AS idx FROM x UNION ALL SELECT id, b, 1.0, CAST(1 AS INT) FROM x UNION ALL SELECT id, c, 1.0, CAST(2 AS INT) FROM x) """


@query(_TERMS + "SELECT * FROM terms", "prompts")
def f07_extract_terms(t: Tables):
    return terms.explode_terms(t.prompts, "id", "prompt")


@query(_TERMS + """, v AS (SELECT term, CASE WHEN idx = 2 THEN s * (1 - weight) ELSE s * weight END AS v FROM (SELECT *, CAST(id % 100 AS DOUBLE) / 100 AS s FROM terms))
SELECT term, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n, max(v) AS max, min(v) AS min FROM v GROUP BY term""", "prompts")
def a13_term_statistics(t: Tables):
    x = terms.explode_terms(t.prompts, "id", "prompt")
    return matrix.term_stats(x.select("term", "weight", (F.col("id") % 100 / 100).alias("score"), (F.col("idx") == 2).alias("negative")))


@query(_TERMS + """, v AS (SELECT term, avg(CAST(id % 100 AS DOUBLE) / 100 * weight) AS mean FROM terms GROUP BY term)
(SELECT term, mean, 'top' AS side FROM v ORDER BY mean DESC, term LIMIT 50) UNION ALL (SELECT term, mean, 'bottom' FROM v ORDER BY mean, term LIMIT 50)""", "prompts")
def o04_term_extremes(t: Tables):
    x = terms.explode_terms(t.prompts, "id", "prompt")
    s = matrix.term_stats(x.select("term", "weight", (F.col("id") % 100 / 100).alias("score"), F.lit(False).alias("negative")))
    return matrix.extremes(s.select("term", "mean"), "mean", 50, "term")


@query("""SELECT id, CASE WHEN p[1] = '(' THEN regexp_extract(p, '^\\(([^:]*):', 1) ELSE trim(p) END AS content, CASE WHEN p[1] = '(' THEN CAST(regexp_extract(p, ':([0-9.]+)\\)', 1) AS DOUBLE) ELSE 1.0 END AS weight
FROM (SELECT id, unnest(string_split(prompt, ',')) AS p FROM prompts)""", "prompts")
def f01_f08_paren_weight(t: Tables):
    parts = t.prompts.select("id", F.explode(F.split("prompt", ",")).alias("p"))
    content, weight = terms.weight_columns(F.col("p"))
    return parts.select("id", content.alias("content"), weight.alias("weight"))


@query("""SELECT id, lower(trim(regexp_replace(regexp_replace(prompt, '\\s+', ' ', 'g'), ':\\s*[0-9]+\\.?[0-9]*$', ''), ' \t\n\r"''`,;:.!?#<>[]{}()')) AS term FROM prompts""", "prompts")
def f03_clean_term(t: Tables):
    return t.prompts.select("id", terms.clean_column(F.col("prompt")).alias("term"))


@query("SELECT sampler, avg(score) AS mean, stddev_pop(score) AS std, count(*) AS n FROM records GROUP BY sampler", "records")
def a14_category_statistics(t: Tables):
    return stats.category_stats(t.records, "sampler")


@query("SELECT avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max FROM records", "records")
def a15_global_statistics(t: Tables):
    return stats.global_stats(t.records)


@query("SELECT corr(steps, cfg) AS r, count(*) AS n FROM records", "records")
def a16_correlation(t: Tables):
    return stats.correlation(t.records, "steps", "cfg")


@query("""WITH r AS (SELECT *, CAST(steps AS DOUBLE) * cfg AS product FROM records), c AS (
  SELECT 'steps' AS feature, CAST(0 AS INT) AS idx, count(*) AS n, corr(steps, score) AS r FROM r UNION ALL SELECT 'cfg', CAST(1 AS INT), count(*), corr(cfg, score) FROM r UNION ALL SELECT 'product', CAST(2 AS INT), count(*), corr(product, score) FROM r)
SELECT feature, idx, n, round(r, 8) AS r, round(r * r * (n - 2) / (1 - r * r), 6) AS f FROM c ORDER BY f DESC LIMIT 2""", "records")
def a17_a18_interaction_scores(t: Tables):
    r = t.records.withColumn("product", F.col("steps").cast("double") * F.col("cfg"))
    out = stats.correlation_scores(r, ["steps", "cfg", "product"], "score", 2)
    return out.withColumns({"r": F.round("r", 8), "f": F.round("f", 6)})


@query("""WITH g AS (SELECT steps, count(*) AS n, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS std FROM records GROUP BY steps), k AS (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) AS keep FROM g)
SELECT steps, n, mean, std FROM (SELECT *, row_number() OVER (ORDER BY n DESC, steps) AS rn FROM g), k WHERE rn <= keep ORDER BY mean DESC, steps LIMIT 10""", "records")
def a19_usage_filtered(t: Tables):
    return stats.usage_filtered(t.records, "steps", "score")


@query("""WITH e AS (SELECT min(cfg) AS mn, max(cfg) AS mx FROM records)
SELECT CAST(least(floor((cfg - mn) * 10 / (mx - mn)), 9) AS INT) AS bin, min(cfg) AS x_low, avg(score) AS mean, stddev_pop(score) AS std, count(*) AS n FROM records, e GROUP BY 1""", "records")
def a20_binned(t: Tables):
    return stats.binned(t.records, "cfg", "score")


@query("""WITH v AS (SELECT *, (rank() OVER (ORDER BY cfg) + rank() OVER (ORDER BY cfg) + count(*) OVER (PARTITION BY cfg) - 1) / 2.0 AS r FROM records),
s AS (SELECT count(*) FILTER (WHERE sampler = 'O') AS na, count(*) FILTER (WHERE sampler <> 'O') AS nb, sum(CASE WHEN sampler = 'O' THEN r END) AS ra, count(*) AS n FROM v),
ties AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS tt FROM (SELECT count(*) AS c FROM records GROUP BY cfg)),
u AS (SELECT na, nb, ra - na * (na + 1) / 2.0 AS u, ra - na * (na + 1) / 2.0 - na * nb / 2.0 AS d, sqrt(na * nb / 12.0 * ((n + 1) - tt / (n * (n - 1.0)))) AS sd FROM s, ties)
SELECT na, nb, u, d / sd AS z, least(1.0, 2 * """ + cdf_sql("((0.5 - abs(d)) / sd)") + """) AS p FROM u""", "records")
def a22_rank_sum(t: Tables):
    return stats.rank_sum(t.records.withColumn("g", F.col("sampler") == "O"), "g", "cfg")


@query("SELECT CAST(floor(score * 10) AS INT) AS tenth, count(*) AS n FROM records GROUP BY 1", "records")
def a23_score_distribution(t: Tables):
    return t.records.groupBy(F.floor(F.col("score") * 10).cast("int").alias("tenth")).agg(F.count("*").alias("n"))


@query("SELECT CAST(i AS INT) AS i, quantile_cont(score, [" + ", ".join(str(k / 256) for k in range(257)) + "])[i + 1] AS q FROM records, unnest(range(257)) t(i) GROUP BY i", "records")
def a24_quantile_table(t: Tables):
    q = calibration.quantiles(t.records, "score")
    return t.spark.createDataFrame([(i, float(x)) for i, x in enumerate(q)], "i int, q double")


@query("SELECT avg(abs(score - cfg / 7)) AS mae, sqrt(avg((score - cfg / 7) * (score - cfg / 7))) AS rmse, 1 - avg((score - cfg / 7) * (score - cfg / 7)) / var_pop(score) AS r2 FROM records", "records")
def a25_regression_metrics(t: Tables):
    return stats.regression_metrics(t.records.withColumn("p", F.col("cfg") / 7), "score", "p")


@query("""WITH c AS (SELECT steps % 3 AS y, CAST(floor(cfg) AS INT) % 3 AS p FROM records), k AS (SELECT DISTINCT y AS k FROM c UNION SELECT DISTINCT p FROM c),
m AS (SELECT k, CAST(count(*) FILTER (WHERE y = k AND p = k) AS DOUBLE) AS tp, count(*) FILTER (WHERE y = k) AS s, count(*) FILTER (WHERE p = k) AS q FROM c, k GROUP BY k),
f AS (SELECT *, CASE WHEN q > 0 THEN tp / q ELSE 0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS re FROM m), g AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM f)
SELECT sum(tp) / sum(s) AS accuracy, avg(pr) AS macro_precision, avg(re) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * s) / sum(s) AS weighted_f1 FROM g""", "records")
def a25_classification_metrics(t: Tables):
    c = t.records.select((F.col("steps") % 3).alias("y"), (F.floor("cfg") % 3).cast("int").alias("p"))
    return stats.classification_metrics(c, "y", "p")


@query("SELECT -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss FROM (SELECT steps % 2 AS y, 0.05 + 0.9 * score AS p FROM records)", "records")
def a25_log_loss(t: Tables):
    return stats.log_loss(t.records.select((F.col("steps") % 2).alias("y"), (0.05 + 0.9 * F.col("score")).alias("p")), "y", "p")


@query("""SELECT avg(CASE WHEN w.score > l.score THEN 1.0 WHEN w.score = l.score THEN 0.5 ELSE 0.0 END) AS accuracy, count(*) AS n FROM comparisons c
JOIN images w ON w.filename = c.winner JOIN images l ON l.filename = CASE WHEN c.winner = c.filename_a THEN c.filename_b ELSE c.filename_a END WHERE c.filename_a <> c.filename_b""", "images")
def a25_pairwise_accuracy(t: Tables):
    return stats.pairwise_accuracy(t.comparisons, t.images)


@query("SELECT regr_slope(cfg, steps) AS slope, regr_intercept(cfg, steps) AS intercept, regr_r2(cfg, steps) AS r2 FROM records", "records")
def a26_linear_fit(t: Tables):
    return stats.linear_fit(t.records, "steps", "cfg")


@query("SELECT c AS category, CAST(row_number() OVER (ORDER BY n DESC, c) - 1 AS INT) AS idx FROM (SELECT event_type AS c, count(*) AS n FROM events WHERE event_type <> '' GROUP BY 1)")
def a33_vocabulary(t: Tables):
    return vectors.vocabulary(t.events.select(F.create_map("event_type", "value").alias("m")), "m")


@query("SELECT max(len(embedding)) * 5 AS size FROM embeddings")
def a34_slot_growth(t: Tables):
    return vectors.slot_growth(t.embeddings, "embedding", 5)


@query("SELECT id, (score - mn) / (mx - mn) AS scaled FROM records, (SELECT min(score) AS mn, max(score) AS mx FROM records)", "records")
def a35_min_max(t: Tables):
    return stats.min_max(t.records, "score").select("id", "scaled")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS p FROM embeddings)
SELECT vec_id, list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * (i - 1))) / list_sum(p) / (len(p) - 1) AS expected FROM e""")
def a36_f23_expected_class(t: Tables):
    return t.embeddings.select("vec_id", vectors.expected_class(vectors.softmax(F.transform("embedding", lambda x: x.cast("double")))).alias("expected"))


@query("SELECT steps, cfg, count(*) AS n FROM records GROUP BY ALL", "records")
def a37_duplicate_points(t: Tables):
    return stats.duplicate_points(t.records, "steps", "cfg")


@query("""SELECT vec_id, CAST(1.0 AS DOUBLE) AS norm2, CAST(embedding[1] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 1e-12) AS first FROM embeddings""")
def f17_l2_normalise(t: Tables):
    v = t.embeddings.select("vec_id", vectors.l2_normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 9).alias("norm2"), F.get("v", F.lit(0)).alias("first"))


@query("SELECT p_partkey AS id, CAST(least(p_size, 20) AS DOUBLE) AS a, CASE WHEN p_brand = 'Brand#2' THEN p_retailprice ELSE 0.0 END AS b, CASE WHEN p_brand = 'Brand#7' THEN p_retailprice ELSE 0.0 END AS c, 0.0 AS d FROM part")
def v01_v03_vectorise(t: Tables):
    e = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.create_map("p_brand", "p_retailprice").alias("brand"))
    slots = [vectors.Slot("width", "number", 1, most=20, alias=("size",)), vectors.Slot("brand", "map", 3, categories=("Brand#2", "Brand#7"))]
    v = vectors.vectorise(e, "id", slots)
    return v.select("id", *[F.get("vector", F.lit(i)).alias(n) for i, n in enumerate("abcd")])


@query("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(p_size + 1 AS DOUBLE) AS c, 0.0 AS d, 0.0 AS e, 0.0 AS f FROM part")
def v04_v06_struct_slots(t: Tables):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    e = t.part.select(F.col("p_partkey").alias("id"), F.array(F.struct(size.alias("x"), price.alias("y")), F.struct((size + 1).alias("x"), F.lit(None).cast("double").alias("y"))).alias("points"))
    v = vectors.vectorise(e, "id", [vectors.Slot("points", "structs", 6, fields=("x", "y"))])
    return v.select("id", *[F.get("vector", F.lit(i)).alias(n) for i, n in enumerate("abcdef")])


@query("SELECT vec_id, flatten(list_transform(range(1, len(embedding)), lambda i: list_transform(embedding[i + 1:], lambda x: CAST(x AS DOUBLE) * CAST(embedding[i] AS DOUBLE)))) AS p FROM embeddings")
def f25_interactions(t: Tables):
    return t.embeddings.select("vec_id", vectors.interactions(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))


@query("SELECT vec_id, embedding[6] AS a, embedding[61] AS b FROM embeddings")
def p19_gather(t: Tables):
    g = t.embeddings.select("vec_id", vectors.gather(F.col("embedding"), [5, 60]).alias("g"))
    return g.select("vec_id", F.get("g", F.lit(0)).alias("a"), F.get("g", F.lit(1)).alias("b"))


_SPLIT = ["size", "price", "mean_quantity"]


@query("""SELECT a.id, a.v AS size, b.v AS price, c.v AS mean_quantity FROM slots a JOIN slots b USING (id) JOIN slots c USING (id)
WHERE a.vector_name = 'size' AND b.vector_name = 'price' AND c.vector_name = 'mean_quantity'""", "slots")
def j06_v09_join_slots(t: Tables):
    s = t.slots.withColumn("vector", F.array("v"))
    j = vectors.join_slots(s, _SPLIT)
    return j.select("id", *[F.get("vector", F.lit(i)).alias(n) for i, n in enumerate(_SPLIT)])


@query("SELECT id FROM slots GROUP BY id HAVING count(DISTINCT vector_name) = 3", "slots")
def u05_complete_ids(t: Tables):
    return vectors.complete_ids(t.slots, 3)


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM slots GROUP BY id HAVING count(DISTINCT vector_name) = 3)", "slots")
def j08_unprocessed(t: Tables):
    return vectors.unprocessed(t.part.select(F.col("p_partkey").alias("id")), t.slots, 3)


@query("SELECT DISTINCT id FROM slots WHERE id NOT IN (SELECT id FROM slots WHERE vector_name = 'price')", "slots")
def j07_missing_slot(t: Tables):
    return vectors.without_slot(t.slots.select("id").distinct(), t.slots, "price")


@query("SELECT s.id, s.v, i.score FROM slots s JOIN records i ON i.id = s.id WHERE s.vector_name = 'price'", "slots", "records")
def j04_vectors_scores(t: Tables):
    v = t.slots.where("vector_name = 'price'").select("id", "v")
    return vectors.with_scores(v, t.records).select("id", "v", "score")


@query("""WITH g AS (SELECT p_partkey AS feature, CAST(p_size - 10 AS DOUBLE) AS gain FROM part WHERE p_size > 10), c AS (
  SELECT *, sum(gain) OVER (ORDER BY gain DESC, feature ROWS UNBOUNDED PRECEDING) / sum(gain) OVER () AS upto, row_number() OVER (ORDER BY gain DESC, feature) AS n FROM g)
SELECT feature, gain FROM c WHERE upto <= 0.5 OR n = 1""")
def w05_cumulative_gain(t: Tables):
    g = t.part.select(F.col("p_partkey").alias("feature"), (F.col("p_size") - 10).cast("double").alias("gain"))
    return vectors.kept_by_gain(g, 0.5)


@query("""SELECT c.id AS pair, s.v, CASE WHEN c.winner = i.filename THEN 1 ELSE 0 END AS label, c.weight FROM comparisons c
JOIN images i ON i.filename = c.filename_a OR i.filename = c.filename_b JOIN slots s ON s.id = CAST(substr(i.filename, 5) AS BIGINT) AND s.vector_name = 'size'
WHERE c.filename_a <> c.filename_b""", "images", "slots")
def j09_m04_pairwise_set(t: Tables):
    v = t.slots.where("vector_name = 'size'").select(F.format_string("img_%08d", "id").alias("id"), F.array("v").alias("vector"))
    p = training.pairwise(t.comparisons, v)
    return p.select("pair", F.get("vector", F.lit(0)).alias("v"), "label", "weight")


@query("SELECT id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM records) WHERE n <= 100 AND (n <= 20 OR score >= 0.995)", "records")
def o10_select_scored(t: Tables):
    return training.select_scored(t.records, 0.995, 20, 100, "score").select("id", "score")


@query("SELECT filename, rating_mu - 3 * rating_sigma AS skill, 1.5 * (rating_mu - 25) / sqrt(2 * (25.0 / 6) * (25.0 / 6) + rating_sigma * rating_sigma + (25.0 / 3) * (25.0 / 3)) AS z FROM images", "images")
def f13_f15_rating_arithmetic(t: Tables):
    mu, s = F.col("rating_mu"), F.col("rating_sigma")
    return t.images.select("filename", rating_math.conservative(mu, s).alias("skill"), rating_math.win_argument(mu, s, F.lit(25.0), F.lit(25.0 / 3)).alias("z"))



@query("SELECT id, CASE WHEN score <= 0.25 THEN score * 2 WHEN score <= 0.75 THEN 0.5 + (score - 0.25) * 0.5 ELSE 0.75 + (score - 0.75) END AS y FROM records", "records")
def f24_piecewise(t: Tables):
    return t.records.select("id", calibration.piecewise(F.col("score"), [0.0, 0.25, 0.75, 1.0], [0.0, 0.5, 0.75, 1.0]).alias("y"))


@query("SELECT md5(coalesce(text, '')) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def f26_hash_groups(t: Tables):
    return t.documents.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("hash")).agg(F.count("*").alias("n")).where("n > 1")
