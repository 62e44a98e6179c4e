"""Queries over the tables: scans, updates, gallery, history, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, etl, gallery, history, tables
from .base import Tables, query

_GALLERY = """
SELECT filename, score, comparison_count, block FROM (
  SELECT *, CASE WHEN strpos(t, 'ring') > 0 AND strpos(t, 'brand#2') > 0 THEN 0 ELSE 1 END AS block FROM (
    SELECT *, lower(concat(coalesce(prompt_tags, ''), ' ', filename)) AS t FROM images WHERE score BETWEEN 0.1 AND 0.9 AND comparison_count BETWEEN 1 AND 1000
  ) WHERE strpos(t, 'ring') > 0 OR strpos(t, 'brand#2') > 0
) ORDER BY block, score DESC, filename LIMIT 50
"""


@query(_GALLERY, "images")
def gallery_page(t: Tables):
    out = gallery.gallery(t.images, ["ring", "Brand#2"], "both", (0.1, 0.9), (1, 1000), "score_desc", 1, 50)
    return out.select("filename", "score", "comparison_count", "block")


@query("SELECT * FROM images", "images")
def s01_image_scan(t: Tables):
    return t.images


@query("SELECT * FROM images WHERE filename = 'img_00000042'", "images")
def s02_image_lookup(t: Tables):
    return tables.lookup(t.images, "img_00000042")


@query("""SELECT * FROM images UNION ALL
SELECT concat('img_9', substr(filename, 6)) AS filename, score, rating_mu, rating_sigma, comparison_count, last_compared_at, ranking_generation, prompt_tags FROM images""", "images")
def s03_insert_or_ignore(t: Tables):
    new = t.images.withColumn("filename", F.expr("concat('img_9', substr(filename, 6))"))
    return tables.insert_images(t.images, t.images.unionByName(new))


@query("""SELECT filename, CASE WHEN hit THEN 1 - score ELSE score END AS score, CASE WHEN hit THEN rating_mu + 1 ELSE rating_mu END AS rating_mu,
CASE WHEN hit THEN rating_sigma / 2 ELSE rating_sigma END AS rating_sigma, CAST(comparison_count + CASE WHEN hit THEN 1 ELSE 0 END AS INT) AS comparison_count,
CASE WHEN hit THEN TIMESTAMP '2024-01-01 00:00:00' ELSE last_compared_at END AS last_compared_at, ranking_generation, prompt_tags
FROM (SELECT *, score > 0.9 AS hit FROM images)""", "images")
def s04_rating_update(t: Tables):
    u = t.images.where("score > 0.9").select("filename", (1 - F.col("score")).alias("score"), (F.col("rating_mu") + 1).alias("rating_mu"), (F.col("rating_sigma") / 2).alias("rating_sigma"), F.lit("2024-01-01").cast("timestamp").alias("compared_at"))
    return tables.update_ratings(t.images, u, "set")


@query("""SELECT filename, score, CASE WHEN score > 0.5 THEN concat('best, ', prompt_tags) ELSE prompt_tags END AS prompt_tags FROM images""", "images")
def s05_tag_update(t: Tables):
    tags = t.images.where("score > 0.5").select("filename", F.concat(F.lit("best, "), "prompt_tags").alias("prompt_tags"))
    return tables.update_tags(t.images, tags).select("filename", "score", "prompt_tags")


@query("""SELECT (SELECT count(*) FROM images) AS images, count(*) AS comparisons, count(*) FILTER (WHERE weight < 1) AS skipped FROM comparisons""", "images")
def s06_s14_counts(t: Tables):
    return tables.counts(t.images, t.comparisons)


@query("SELECT (SELECT count(*) FROM images) AS images, (SELECT count(*) FROM comparisons) AS comparisons, CAST(0 AS BIGINT) AS images_after, CAST(0 AS BIGINT) AS comparisons_after", "images")
def s07_s13_truncate(t: Tables):
    n = [x.agg(F.count("*").alias(k)) for k, x in (("images", t.images), ("comparisons", t.comparisons), ("images_after", tables.truncated(t.images)), ("comparisons_after", tables.truncated(t.comparisons)))]
    return n[0].crossJoin(n[1]).crossJoin(n[2]).crossJoin(n[3])  # one row each


@query("""SELECT filename, CAST(0.5 AS DOUBLE) AS score, CAST(25.0 AS DOUBLE) AS rating_mu, CAST(25.0 AS DOUBLE) / 3 AS rating_sigma, CAST(0 AS INT) AS comparison_count,
CAST(NULL AS TIMESTAMP) AS last_compared_at, ranking_generation, prompt_tags FROM images""", "images")
def s08_reset_ratings(t: Tables):
    return tables.reset_ratings(t.images)


@query("SELECT * FROM comparisons WHERE weight = 0.5", "comparisons")
def s09_comparison_scan(t: Tables):
    return tables.scan_comparisons(t.comparisons, 0.5)


@query("""SELECT * FROM comparisons UNION ALL
SELECT id + 1000000000, filename_a, filename_b, winner, timestamp, weight, transitive_depth FROM comparisons""", "comparisons")
def s10_append(t: Tables):
    new = t.comparisons.withColumns({"id": F.col("id") + 1000000000, "filename_a": F.col("filename_b"), "filename_b": F.col("filename_a")})
    bad = t.comparisons.withColumn("winner", F.lit("nobody"))
    return tables.append_comparisons(t.comparisons, new.unionByName(bad))


@query("""SELECT * FROM comparisons UNION ALL SELECT id + 1000000000, filename_a, filename_b, winner, timestamp, CAST(0.25 AS DOUBLE), transitive_depth FROM (
  SELECT min(id) AS id, filename_a, filename_b, winner, timestamp, transitive_depth FROM comparisons GROUP BY ALL)""", "comparisons")
def s11_historical_append(t: Tables):
    same = t.comparisons.withColumn("id", F.col("id") + 2000000000)
    new = t.comparisons.groupBy("filename_a", "filename_b", "winner", "timestamp", "transitive_depth").agg(F.min("id").alias("id"))
    new = new.withColumns({"id": F.col("id") + 1000000000, "weight": F.lit(0.25)}).select(*same.columns)
    return tables.append_history(t.comparisons, same.unionByName(new))


@query("""SELECT DISTINCT filename_a, filename_b FROM comparisons""", "comparisons")
def s12_pair_exists(t: Tables):
    some = t.comparisons.select(F.col("filename_b").alias("filename_a"), F.col("filename_a").alias("filename_b")).distinct()
    none = some.select(F.lit("nobody").alias("filename_a"), "filename_b")
    return tables.existing_pairs(some.union(none), t.comparisons)


@query("""SELECT 'db_version' AS key, '5' AS value UNION ALL SELECT 'ranking_generation', '0' UNION ALL SELECT 'new', '1'""")
def s16_meta_upsert(t: Tables):
    meta = t.spark.createDataFrame([("db_version", "4"), ("ranking_generation", "0")], "key string, value string")
    return tables.upsert_meta(meta, t.spark.createDataFrame([("db_version", "5"), ("new", "1")], "key string, value string"))


@query("""SELECT id, least(filename_a, filename_b) AS filename_a, greatest(filename_a, filename_b) AS filename_b, winner,
CASE WHEN winner = filename_a THEN filename_b ELSE filename_a END AS loser FROM comparisons WHERE winner = filename_a OR winner = filename_b""", "comparisons")
def p01_p03_canonical_loser(t: Tables):
    return tables.with_loser(tables.valid_winner(tables.canonical(t.comparisons))).select("id", "filename_a", "filename_b", "winner", "loser")


@query("SELECT filename, score, comparison_count FROM images WHERE score BETWEEN 0.25 AND 0.75 AND comparison_count BETWEEN 10 AND 60", "images")
def p04_range_filter(t: Tables):
    return gallery.in_range(t.images, (0.25, 0.75), (10, 60)).select("filename", "score", "comparison_count")


@query("""SELECT filename, CAST(0 AS INT) AS block FROM images WHERE strpos(lower(concat(prompt_tags, ' ', filename)), 'widget') > 0 AND strpos(lower(concat(prompt_tags, ' ', filename)), 'red') > 0""", "images")
def p05_tags_and(t: Tables):
    return gallery.tagged(t.images, ["widget", "red"], "and").select("filename", "block")


@query("""SELECT filename, CAST(0 AS INT) AS block FROM images WHERE strpos(lower(concat(prompt_tags, ' ', filename)), 'widget') > 0 OR strpos(lower(concat(prompt_tags, ' ', filename)), '77') > 0""", "images")
def p05_tags_or(t: Tables):
    return gallery.tagged(t.images, ["widget", "77"], "or").select("filename", "block")


@query("SELECT filename, score FROM images WHERE score BETWEEN 0 AND 0.5 AND strpos(filename, '001') > 0", "images")
def p06_filename_search(t: Tables):
    return gallery.by_filename(t.images, "001", (0.0, 0.5)).select("filename", "score")


@query("SELECT filename FROM images WHERE filename NOT IN (SELECT winner FROM comparisons WHERE weight < 1)", "images")
def p07_exclude(t: Tables):
    lost = t.comparisons.where("weight < 1").select(F.col("winner").alias("filename"))
    return tables.exclude(t.images, lost).select("filename")


@query("""SELECT filename, concat('scored_', CAST(CAST(floor(least(greatest(score, 0), 1) * 10) / 10 AS DECIMAL(3, 1)) AS VARCHAR),
CASE WHEN (n >= 150 OR k IN (3, 7)) AND k < 10 THEN concat('/scored_', CAST(CAST(floor(least(greatest(score, 0), 1) * 100) / 100 AS DECIMAL(4, 2)) AS VARCHAR)) ELSE '' END) AS folder
FROM (SELECT *, floor(score * 10) AS k, count(*) OVER (PARTITION BY floor(score * 10)) AS n FROM images WHERE filename NOT LIKE '%7' OR score >= 0.5)""", "images")
def p14_tier_path(t: Tables):
    """Folders of hundredths where there are many images, or where there are such folders already."""
    there = t.images.where("score >= 0.3 and score < 0.4 or score >= 0.7 and score < 0.8").select(F.concat(F.lit("/ranked/scored_"), F.format_number(F.floor(F.col("score") * 10) / 10, 1), F.lit("/scored_"), F.format_number(F.floor(F.col("score") * 100) / 100, 2), F.lit("/"), "filename").alias("path"))
    return etl.tier_plan(t.images.where("filename not like '%7' or score >= 0.5"), 150, etl.split_tiers(there))


@query("SELECT filename, last_compared_at FROM images ORDER BY coalesce(CAST(last_compared_at AS VARCHAR), '9999-99-99'), filename LIMIT 30 OFFSET 30", "images")
def o01_o02_sorted_page(t: Tables):
    return gallery.page(t.images, "last_compared_asc", 2, 30).select("filename", "last_compared_at")


@query("SELECT filename, comparison_count FROM images ORDER BY comparison_count DESC, filename LIMIT 20", "images")
def o01_comparisons_desc(t: Tables):
    return gallery.page(t.images, "comparisons_desc", 1, 500).select("filename", "comparison_count")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100 OFFSET 30")
def o09_newest_batch(t: Tables):
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), "event_id").offset(30).limit(100)


@query("SELECT coalesce(max(comparison_count), 0) AS max_comparisons FROM images", "images")
def a10_max_comparisons(t: Tables):
    return gallery.most_compared(t.images)


@query("SELECT filename FROM (SELECT winner AS filename FROM dag EXCEPT SELECT filename_b FROM dag)", "dag")
def u01_only_winners(t: Tables):
    return tables.only_winners(t.dag)


@query("SELECT filename FROM (SELECT filename_b AS filename FROM dag EXCEPT SELECT winner FROM dag)", "dag")
def u02_only_losers(t: Tables):
    return tables.only_losers(t.dag)


@query("SELECT * FROM comparisons WHERE weight = 1", "comparisons")
def u03_keep_ids(t: Tables):
    return tables.keep_ids(t.comparisons, t.comparisons.where("weight = 1").select("id"))


@query("SELECT filename_a AS filename FROM comparisons UNION SELECT filename_b FROM comparisons", "comparisons")
def u04_j19_nodes(t: Tables):
    return tables.nodes(t.comparisons)


@query("SELECT DISTINCT filename_a, filename_b FROM comparisons", "comparisons")
def u09_link_set(t: Tables):
    return tables.link_set(t.comparisons)


@query("""SELECT s.filename, s.other, s.comparison_id, coalesce(i.score, 0.5) AS opponent_score, s.won, s.weight FROM (
  SELECT filename_a AS filename, filename_b AS other, id AS comparison_id, winner = filename_a AS won, weight FROM comparisons
  UNION ALL SELECT filename_b, filename_a, id, winner = filename_b, weight FROM comparisons) s LEFT JOIN images i ON i.filename = s.other""", "images")
def j02_history_rows(t: Tables):
    return history.rows(t.comparisons, t.images).select("filename", "other", "comparison_id", "opponent_score", "won", "weight")


@query("""SELECT s.comparison_id, s.other, coalesce(i.score, 0.5) AS opponent_score, s.won FROM (
  SELECT filename_b AS other, id AS comparison_id, winner = filename_a AS won FROM comparisons WHERE filename_a = 'img_00000100'
  UNION ALL SELECT filename_a, id, winner = filename_b FROM comparisons WHERE filename_b = 'img_00000100') s LEFT JOIN images i ON i.filename = s.other""", "images")
def j03_image_history(t: Tables):
    return history.of_image(t.comparisons, t.images, "img_00000100").select("comparison_id", "other", "opponent_score", "won")


@query("""SELECT filename, string_agg(CAST(id AS VARCHAR) || ' ' || other || ' ' || CAST(won AS VARCHAR), ',' ORDER BY timestamp, id) AS history FROM (
    SELECT filename_a AS filename, filename_b AS other, id, timestamp, winner = filename_a AS won FROM comparisons UNION ALL SELECT filename_b, filename_a, id, timestamp, winner = filename_b FROM comparisons) GROUP BY filename""", "comparisons")
def w02_history_arrays(t: Tables):
    h = history.arrays(t.comparisons.where("filename_a <> filename_b").union(t.comparisons.where("filename_a = filename_b")), t.images)
    one = F.transform("history", lambda x: F.concat_ws(" ", x["comparison_id"].cast("string"), x["other"], x["winner"].cast("string")))
    return h.select("filename", F.array_join(one, ",").alias("history"))


@query("""SELECT filename, comparison_id, source FROM (
  SELECT *, row_number() OVER (PARTITION BY filename, comparison_id ORDER BY o) AS n FROM (
    SELECT filename_a AS filename, id AS comparison_id, 'keeper' AS source, 0 AS o FROM comparisons WHERE weight < 1
    UNION ALL SELECT filename_a, id, 'copy', 1 FROM comparisons)) WHERE n = 1""", "comparisons")
def u07_history_merge(t: Tables):
    h = t.comparisons.select(F.col("filename_a").alias("filename"), F.col("id").alias("comparison_id"), "timestamp", "weight")
    out = history.merge(h.where("weight < 1").drop("weight").withColumn("source", F.lit("keeper")), h.drop("weight").withColumn("source", F.lit("copy")))
    return out.select("filename", "comparison_id", "source")


@query("""SELECT filename, count(DISTINCT CASE WHEN won THEN other END) AS wins, count(DISTINCT CASE WHEN NOT won THEN other END) AS losses FROM (
  SELECT filename_a AS filename, filename_b AS other, winner = filename_a AS won FROM comparisons
  UNION ALL SELECT filename_b, filename_a, winner = filename_b FROM comparisons) WHERE filename <> other GROUP BY filename""", "comparisons")
def a03_wins_losses(t: Tables):
    return history.wins_losses(t.comparisons)


_CLEAN = """WITH known AS (SELECT filename FROM images WHERE comparison_count >= 40), flags AS (
  SELECT *, filename_a IN (SELECT filename FROM known) AND filename_b IN (SELECT filename FROM known) AS ok, filename_a = filename_b AS own FROM comparisons
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY filename_a, filename_b, ok AND NOT own, winner ORDER BY timestamp DESC NULLS LAST, id DESC) AS w,
         row_number() OVER (PARTITION BY filename_a, filename_b, ok AND NOT own ORDER BY timestamp DESC NULLS LAST, id DESC) AS p FROM flags
), fates AS (SELECT *, CASE WHEN NOT ok THEN 'missing' WHEN own THEN 'self' WHEN w > 1 THEN 'duplicate' WHEN p > 1 THEN 'contradiction' ELSE 'kept' END AS fate FROM ranked)
"""


@query(_CLEAN + "SELECT id, filename_a, filename_b, winner FROM fates WHERE fate = 'kept'", "images")
def c01_w01_clean(t: Tables):
    return cleaning.clean(t.comparisons, t.images.where("comparison_count >= 40")).select("id", "filename_a", "filename_b", "winner")


@query(_CLEAN + """SELECT count(*) FILTER (WHERE fate = 'missing') AS missing_nodes_removed, count(*) FILTER (WHERE fate = 'self') AS self_links_removed,
count(*) FILTER (WHERE fate = 'duplicate') AS same_direction_duplicates_removed, count(*) FILTER (WHERE fate = 'contradiction') AS contradictions_removed,
count(*) FILTER (WHERE fate = 'kept') AS kept FROM fates""", "images")
def a32_cleaning_counters(t: Tables):
    return cleaning.counters(t.comparisons, t.images.where("comparison_count >= 40"))


@query("SELECT id, filename_a, filename_b, winner, timestamp, weight FROM comparisons WHERE filename_a IN (SELECT filename FROM images WHERE score < 0.9) AND filename_b IN (SELECT filename FROM images WHERE score < 0.9)", "images")
def j01_known_ends(t: Tables):
    ok = t.images.where("score < 0.9").select("filename")
    a = t.comparisons.join(ok.withColumnRenamed("filename", "filename_a"), "filename_a", "left_semi")
    return a.join(ok.withColumnRenamed("filename", "filename_b"), "filename_b", "left_semi").select("id", "filename_a", "filename_b", "winner", "timestamp", "weight")


_FILES = """WITH files AS (SELECT concat('/data/', CASE WHEN p_size > 30 THEN 'raw/' ELSE '' END, 'f', CAST(p_partkey AS VARCHAR), '.png') AS path FROM part WHERE p_retailprice > 950
UNION ALL SELECT concat('/data/', CASE WHEN p_size > 30 THEN 'raw/' ELSE '' END, 'f', CAST(p_partkey AS VARCHAR), '.json') FROM part WHERE p_size < 45)"""


def _files(t: Tables):
    path = F.concat(F.lit("/data/"), F.when(F.col("p_size") > 30, "raw/").otherwise(""), F.lit("f"), F.col("p_partkey").cast("string"))
    png = t.part.where("p_retailprice > 950").select(F.concat(path, F.lit(".png")).alias("path"))
    return png.union(t.part.where("p_size < 45").select(F.concat(path, F.lit(".json"))))


@query(_FILES + """, p AS (SELECT regexp_replace(path, '\\.[^.]*$', '') AS k, regexp_replace(path, '/[^/]*$', '') AS dir, max(CASE WHEN path LIKE '%.png' THEN path END) AS image, max(CASE WHEN path LIKE '%.json' THEN path END) AS sidecar FROM files GROUP BY ALL)
SELECT dir, regexp_replace(k, '^.*/', '') AS stem, image, sidecar FROM p""")
def s20_j16_paired_files(t: Tables):
    return etl.paired(_files(t))


@query(_FILES + """, p AS (SELECT *, regexp_replace(path, '\\.[^.]*$', '') AS k, regexp_replace(path, '/[^/]*$', '') AS dir, count(*) OVER (PARTITION BY regexp_replace(path, '\\.[^.]*$', '')) AS n FROM files)
SELECT path, CASE WHEN n = 1 AND dir = '/data' THEN 'delete' ELSE 'move' END AS action,
CASE WHEN n = 2 THEN concat('/data/scored_0.5/', regexp_replace(path, '^.*/', '')) WHEN dir <> '/data' THEN concat('/data/', regexp_replace(path, '^.*/', '')) END AS target
FROM p WHERE (n = 2 AND dir = '/data') OR n = 1""")
def e06_orphan_plan(t: Tables):
    return etl.orphan_plan(_files(t), "/data")


@query("""WITH f AS (SELECT concat('/d/', CAST(doc_id % 50 AS VARCHAR), '/s', CAST(doc_id % 70 AS VARCHAR), '.', CAST(doc_id AS VARCHAR), '.png') AS path, concat('s', CAST(doc_id % 70 AS VARCHAR), '.', CAST(doc_id AS VARCHAR)) AS own, md5(coalesce(text, '')) AS hash, doc_id AS modified FROM documents
  UNION ALL SELECT concat('/e/s', CAST(doc_id % 70 AS VARCHAR), '.', CAST(doc_id AS VARCHAR), '.png'), concat('s', CAST(doc_id % 70 AS VARCHAR), '.', CAST(doc_id AS VARCHAR)), md5(concat('other', coalesce(text, ''))), doc_id + 5 FROM documents WHERE doc_id % 3 = 0),
k AS (SELECT *, row_number() OVER w AS n, first_value(path) OVER w AS keeper FROM f WINDOW w AS (PARTITION BY hash ORDER BY modified DESC, path)),
s AS (SELECT path, row_number() OVER (PARTITION BY own ORDER BY modified DESC, path) AS c FROM k WHERE n = 1)
SELECT k.path, CASE WHEN n > 1 THEN 'merge' WHEN c > 1 THEN 'rename' ELSE 'keep' END AS action, keeper, CASE WHEN c > 1 THEN concat(own, '_', CAST(c AS VARCHAR)) ELSE own END AS stem FROM k LEFT JOIN s ON s.path = k.path""")
def e05_j17_duplicate_plan(t: Tables):
    """Copies of a content, and different contents of one stem in two folders."""
    own = F.concat(F.lit("s"), (F.col("doc_id") % 70).cast("string"), F.lit("."), F.col("doc_id").cast("string"), F.lit(".png"))
    text = F.coalesce("text", F.lit(""))
    f = t.documents.select(F.concat(F.lit("/d/"), (F.col("doc_id") % 50).cast("string"), F.lit("/"), own).alias("path"), F.md5(text).alias("hash"), F.col("doc_id").alias("modified"))
    f = f.union(t.documents.where("doc_id % 3 = 0").select(F.concat(F.lit("/e/"), own), F.md5(F.concat(F.lit("other"), text)), F.col("doc_id") + 5))
    return etl.duplicate_plan(f).select("path", "action", "keeper", "stem")


@query("SELECT filename, score, comparison_count FROM images WHERE NOT (comparison_count >= 40 AND score < 0.7)", "images")
def s36_sync_plan(t: Tables):
    old = t.images.where("comparison_count >= 40").withColumn("score", F.when(F.col("score") < 0.7, F.col("score")))
    return etl.sync_plan(t.images, old).select("filename", "score", "comparison_count")


@query("SELECT DISTINCT id, filename_a, filename_b, winner, timestamp, weight FROM comparisons WHERE filename_a <> filename_b", "comparisons")
def e03_rebuild_from_histories(t: Tables):
    h = history.arrays(t.comparisons.where("filename_a <> filename_b"), t.images)
    return etl.rebuild(h).select("id", "filename_a", "filename_b", "winner", "timestamp", "weight")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s18_d04_json_fields(t: Tables):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT filename_a, filename_b, winner, timestamp, weight FROM comparisons", "comparisons")
def s35_export(t: Tables):
    from ..operators.rating import export_comparisons

    return export_comparisons(t.comparisons)
