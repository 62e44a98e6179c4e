"""Queries of the win-loss graph, the ratings and the pair selection."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rating_math
from ..operators import graph, live, pairing, rating, tables
from ..operators.history import tallies
from ..scratch import scratch
from ..sources.fixtures import ctes
from .base import Tables, query

_EDGES = "edges AS (SELECT DISTINCT winner, filename_b AS loser FROM dag), nodes AS (SELECT winner AS node FROM edges UNION SELECT loser FROM edges), ends AS (SELECT winner AS a, loser AS b FROM edges UNION SELECT loser, winner FROM edges)"
_REACH = _EDGES + ", reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b), labels AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"


def _edges(t: Tables):
    return t.once("edges", lambda: scratch(graph.edges(t.dag_rows)))


def _dag(t: Tables):
    """The comparisons of the acyclic graph as written once: its view has no two rows of one pair, and the winner comes first."""
    return _edges(t).select(F.col("winner").alias("filename_a"), F.col("loser").alias("filename_b"), "winner")


def _labels(t: Tables):
    e = _edges(t)
    return t.once("labels", lambda: graph.components(None, e))


def _candidates(images):
    """Written, as the phases read them several times."""
    return scratch(pairing.candidates(images), "candidates")


def _chains(t: Tables):
    return t.once("chains", lambda: scratch(graph.chains(None, _edges(t))))


@query("SELECT DISTINCT winner, CASE WHEN winner = filename_a THEN filename_b ELSE filename_a END AS loser FROM comparisons WHERE filename_a <> filename_b", "comparisons")
def g01_edges(t: Tables):
    return graph.edges(t.comparisons)


@query(f"WITH {_EDGES} SELECT node, node NOT IN (SELECT loser FROM edges) AS is_top, node NOT IN (SELECT winner FROM edges) AS is_bottom FROM nodes", "dag")
def g02_extremes(t: Tables):
    e = _edges(t)
    return graph.extremes(graph.universe(e), e)


@query(f"WITH {_REACH} SELECT * FROM labels", "dag", recursive=True)
def g03_components(t: Tables):
    return _labels(t)


@query(f"""WITH {_REACH}, x AS (SELECT component, count(*) AS size, count(*) FILTER (WHERE node NOT IN (SELECT loser FROM edges)) AS tops,
count(*) FILTER (WHERE node NOT IN (SELECT winner FROM edges)) AS bottoms FROM labels GROUP BY component) SELECT *, tops >= 2 OR bottoms >= 2 AS collapsible FROM x""", "dag", recursive=True)
def a27_a28_component_metrics(t: Tables):
    e = _edges(t)
    return graph.component_sizes(_labels(t), graph.extremes(graph.universe(e), e))


_CYCLIC = """cedges AS (SELECT DISTINCT winner, filename_b AS loser FROM cyclic), cnodes AS (SELECT winner AS node FROM cedges UNION SELECT loser FROM cedges),
below(a, b) AS (SELECT node, node FROM cnodes UNION SELECT r.a, e.loser FROM below r JOIN cedges e ON e.winner = r.b),
parts AS (SELECT x.a AS node, min(x.b) AS scc, count(*) AS size FROM below x JOIN below y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


_ONE_LARGE = """cedges AS (SELECT DISTINCT winner, CASE WHEN winner = filename_a THEN filename_b ELSE filename_a END AS loser FROM comparisons WHERE filename_a <> filename_b),
cnodes AS (SELECT winner AS node FROM cedges UNION SELECT loser FROM cedges),
hub AS (SELECT winner AS node FROM cedges GROUP BY winner ORDER BY count(*) DESC, winner LIMIT 1),
below(node) AS (SELECT node FROM hub UNION SELECT e.loser FROM below b JOIN cedges e ON e.winner = b.node), above(node) AS (SELECT node FROM hub UNION SELECT e.winner FROM above a JOIN cedges e ON e.loser = a.node),
large AS (SELECT node FROM below INTERSECT SELECT node FROM above), others AS (SELECT node FROM cnodes EXCEPT SELECT node FROM large),
oedges AS (SELECT winner, loser FROM cedges WHERE winner IN (SELECT node FROM others) AND loser IN (SELECT node FROM others)),
far(a, b) AS (SELECT node, node FROM others UNION SELECT f.a, e.loser FROM far f JOIN oedges e ON e.winner = f.b),
parts AS (SELECT x.a AS node, min(x.b) AS scc, count(*) AS size FROM far x JOIN far y ON x.a = y.b AND x.b = y.a GROUP BY x.a UNION ALL SELECT node, (SELECT min(node) FROM large), (SELECT count(*) FROM large) FROM large)"""


@query(f"WITH {_ONE_LARGE} SELECT * FROM parts", "comparisons", recursive=True)
def g04_giant_component(t: Tables):
    """Nearly all images are one weak and one strong component: trimmed and coloured. The twin takes the part around one image out and closes over the rest."""
    e = scratch(graph.edges(t.comparisons))
    return graph.strong_components(graph.components(graph.universe(e), e), e, 1000).select("node", "scc", "size")


def _strong(t: Tables):
    e = scratch(graph.edges(t.cyclic), "edges")
    return graph.strong_components(graph.components(graph.universe(e), e), e), e


@query(f"WITH {_CYCLIC} SELECT * FROM parts", "cyclic", recursive=True)
def g04_strong_components(t: Tables):
    return _strong(t)[0].select("node", "scc", "size")


@query(f"WITH {_CYCLIC} SELECT DISTINCT w.scc AS winner, l.scc AS loser FROM cedges e JOIN parts w ON w.node = e.winner JOIN parts l ON l.node = e.loser WHERE w.scc <> l.scc", "cyclic", recursive=True)
def g05_condensation(t: Tables):
    return graph.condensation(*_strong(t))


@query(f"WITH {_CYCLIC} SELECT min(size) AS least, max(size) AS most, count(DISTINCT scc) AS parts FROM parts", "cyclic", recursive=True)
def g04_cycles_are_there(t: Tables):
    return _strong(t)[0].agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count_distinct("scc").alias("parts"))


@query(f"""WITH {_CYCLIC} SELECT n.node, n.node NOT IN (SELECT loser FROM cedges) AS is_top, n.node NOT IN (SELECT winner FROM cedges) AS is_bottom FROM cnodes n""", "cyclic", recursive=True)
def g02_extremes_with_cycles(t: Tables):
    e = graph.edges(t.cyclic)
    return graph.extremes(graph.universe(e), e)


@query(f"WITH {_EDGES}, walk(node, level) AS (SELECT node, 0 FROM nodes UNION SELECT e.loser, w.level + 1 FROM walk w JOIN edges e ON e.winner = w.node) SELECT node, CAST(max(level) AS INT) AS level FROM walk GROUP BY node", "dag", recursive=True)
def g06_topological_levels(t: Tables):
    e = _edges(t)
    return graph.levels(graph.universe(e), e)


_LONGEST = _EDGES + """, down(top, node, level) AS (SELECT node, node, 1 FROM nodes UNION SELECT d.top, e.loser, d.level + 1 FROM down d JOIN edges e ON e.winner = d.node),
fall AS (SELECT top AS node, max(level) AS f FROM down GROUP BY top), rise AS (SELECT node, max(level) AS r FROM down GROUP BY node)"""


@query(f"WITH {_LONGEST} SELECT node, CAST(max(r + f - 1) AS BIGINT) AS own FROM fall JOIN rise USING (node) GROUP BY node", "dag", recursive=True)
def g07_g09_main_chain_lengths(t: Tables):
    c = _chains(t)
    return c.select(F.explode("owners").alias("node"), F.col("length").alias("own"))


@query(f"WITH {_LONGEST} SELECT CAST(max(r + f - 1) AS BIGINT) AS longest, count(*) AS nodes FROM fall JOIN rise USING (node)", "dag", recursive=True)
def a31_longest_chain(t: Tables):
    e = _edges(t)
    s = graph.stats(graph.universe(e), e, _labels(t), _chains(t))
    return s.select("longest", "nodes")


def chains_sql(view: str) -> str:
    """CTEs up to chains (component, nodes, length, owners, chain_id) of an acyclic view, from the definition: from each node the
    longest way up, turned round, and the longest way down, of equal ones by the smallest next name; equal chains are one, numbered by their nodes."""
    return f"""edges AS MATERIALIZED (SELECT DISTINCT winner, filename_b AS loser FROM {view}), nodes AS MATERIALIZED (SELECT winner AS node FROM edges UNION SELECT loser FROM edges),
ends AS (SELECT winner AS a, loser AS b FROM edges UNION SELECT loser, winner FROM edges), low AS MATERIALIZED (SELECT node FROM nodes EXCEPT SELECT a FROM ends WHERE b < a),
reach(a, b) AS (SELECT node, node FROM low UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b), labels AS (SELECT b AS node, min(a) AS component FROM reach GROUP BY b),
sink(node, n) AS (SELECT node, 1 FROM nodes UNION SELECT e.winner, s.n + 1 FROM sink s JOIN edges e ON e.loser = s.node), fall AS MATERIALIZED (SELECT node, max(n) AS n FROM sink GROUP BY node),
climb(node, n) AS (SELECT node, 1 FROM nodes UNION SELECT e.loser, c.n + 1 FROM climb c JOIN edges e ON e.winner = c.node), rise AS MATERIALIZED (SELECT node, max(n) AS n FROM climb GROUP BY node),
lower AS MATERIALIZED (SELECT winner AS node, min(loser) AS other FROM edges JOIN fall x ON x.node = winner JOIN fall y ON y.node = loser WHERE y.n = x.n - 1 GROUP BY winner),
upper AS MATERIALIZED (SELECT loser AS node, min(winner) AS other FROM edges JOIN rise x ON x.node = loser JOIN rise y ON y.node = winner WHERE y.n = x.n - 1 GROUP BY loser),
downs(node, tip, path) AS (SELECT node, node, [node] FROM nodes UNION ALL SELECT d.node, other, list_append(path, other) FROM downs d JOIN lower ON lower.node = d.tip),
ups(node, tip, path) AS (SELECT node, node, [node] FROM nodes UNION ALL SELECT u.node, other, list_prepend(other, path) FROM ups u JOIN upper ON upper.node = u.tip),
whole AS (SELECT node, list_concat(u.path, d.path[2:]) AS nodes FROM (SELECT node, arg_max(path, len(path)) AS path FROM downs GROUP BY node) d JOIN (SELECT node, arg_max(path, len(path)) AS path FROM ups GROUP BY node) u USING (node)),
chains AS (SELECT *, component || '#' || (row_number() OVER (PARTITION BY component ORDER BY nodes) - 1) AS chain_id FROM (
  SELECT component, nodes, CAST(len(nodes) AS BIGINT) AS length, list(node ORDER BY node) AS owners FROM whole JOIN labels USING (node) GROUP BY component, nodes)),
heights AS (SELECT node, max(length) AS height FROM (SELECT unnest(nodes) AS node, length FROM chains) GROUP BY node)"""


_DAG = f"WITH {chains_sql('dag')}"
_GIANT = f"WITH {chains_sql('tiers')}"


def _giant_chains(t: Tables):
    """Chains of a graph that is nearly one component, by rounds of joins."""
    e = scratch(graph.edges(t.tiers))
    labels = graph.components(graph.universe(e), e)
    return scratch(graph.chains(labels, e, 100))


@query(f"{_DAG} SELECT length, count(*) AS n, CAST(sum(length) AS BIGINT) AS nodes FROM chains GROUP BY length", "dag", recursive=True)
def g14_chain_map(t: Tables):
    return graph.chain_map(_chains(t))


@query(f"{_GIANT} SELECT chain_id, length, array_to_string(nodes, ' ') AS nodes, array_to_string(owners, ' ') AS owners FROM chains", "tiers", recursive=True)
def g09_giant_chains(t: Tables):
    return _giant_chains(t).select("chain_id", "length", F.array_join("nodes", " ").alias("nodes"), F.array_join("owners", " ").alias("owners"))


@query(f"{_GIANT} SELECT node, height FROM heights", "tiers", recursive=True)
def a29_giant_heights(t: Tables):
    return graph.heights(_giant_chains(t))


@query(f"{_DAG} SELECT chain_id, length, nodes[1] AS first, nodes[-1] AS last, nodes[length // 2 + 1] AS middle FROM chains", "dag", recursive=True)
def g16_chain_extremes(t: Tables):
    return graph.chain_extremes(_chains(t))


@query(f"{_DAG} SELECT node, height FROM heights", "dag", recursive=True)
def a29_heights(t: Tables):
    return graph.heights(_chains(t))


@query(f"{_DAG} SELECT chain_id, CAST(len(owners) AS INT) AS n FROM chains", "dag", recursive=True)
def a30_main_counts(t: Tables):
    return graph.main_counts(_chains(t))


@query(f"{_DAG} SELECT chain_id, length FROM chains WHERE length >= 3 ORDER BY length DESC, chain_id", "dag", recursive=True)
def o13_sorted_chains(t: Tables):
    return graph.sorted_chains(_chains(t), 3, False).select("chain_id", "length")


@query(f"""{_DAG} SELECT n.node, coalesce(score, 0.5) AS score, coalesce(rating_mu, 25.0) AS mu, coalesce(rating_sigma, CAST(25 AS DOUBLE) / 3) AS sigma, coalesce(comparison_count, 0) AS comparison_count, component, height
FROM nodes n LEFT JOIN images i ON i.filename = n.node JOIN labels USING (node) JOIN heights USING (node)""", "dag", "images", recursive=True)
def j11_g15_graph_data(t: Tables):
    return graph.graph_data(None, t.images, None, graph.placed(_chains(t)))


@query(f"{_DAG} SELECT chain_id, length, unnest(nodes) AS node, CAST(unnest(range(length)) AS INT) AS place, list_contains(owners, unnest(nodes)) AS is_main FROM chains", "dag", recursive=True)
def g18_g22_chain_accessors(t: Tables):
    return graph.chain_members(_chains(t))


_NEAR = _EDGES + ", hop(a, b, d) AS (SELECT winner, winner, 0 FROM edges UNION SELECT h.a, e.loser, h.d + 1 FROM hop h JOIN edges e ON e.winner = h.b WHERE h.d < 5)"


@query(f"WITH {_NEAR} SELECT a AS start, b AS node, CAST(min(d) AS INT) AS depth FROM hop WHERE d > 0 GROUP BY ALL", "dag", recursive=True)
def g10_reachable(t: Tables):
    e = _edges(t)
    return graph.reachable(e, e.select(F.col("winner").alias("node")).distinct())


@query(f"""WITH {_NEAR}, p AS (SELECT x.winner AS a, y.loser AS b FROM edges x JOIN edges y ON x.loser = y.winner UNION SELECT winner, 'img_00000000' FROM edges)
SELECT DISTINCT p.a, p.b, p.a = p.b OR EXISTS (SELECT 1 FROM hop WHERE hop.a = p.a AND hop.b = p.b AND d > 0) OR EXISTS (SELECT 1 FROM hop WHERE hop.a = p.b AND hop.b = p.a AND d > 0) AS same_path FROM p""", "dag", recursive=True)
def g10_same_path(t: Tables):
    e = _edges(t)
    x = e.select(F.col("winner").alias("a"), F.col("loser").alias("m"))
    p = x.join(e.select(F.col("winner").alias("m"), F.col("loser").alias("b")), "m").select("a", "b")
    p = p.union(x.select("a", F.lit("img_00000000").alias("b"))).distinct()
    return graph.same_path(p, e, _labels(t), index=graph.reach_index(e))


@query(f"""WITH RECURSIVE {ctes("tiers")}, edges AS MATERIALIZED (SELECT DISTINCT winner, filename_b AS loser FROM tiers), ids AS MATERIALIZED (SELECT DISTINCT winner AS node FROM edges),
p AS MATERIALIZED (SELECT x.node AS a, y.node AS b FROM ids x JOIN ids y ON CAST(substr(y.node, 5) AS BIGINT) - CAST(substr(x.node, 5) AS BIGINT) IN (1, 3, 50)),
hop(a, b, d) AS (SELECT node, node, 0 FROM ids UNION SELECT h.a, e.loser, h.d + 1 FROM hop h JOIN edges e ON e.winner = h.b WHERE h.d < 2)
SELECT p.a, p.b, EXISTS (SELECT 1 FROM hop WHERE hop.a = p.a AND hop.b = p.b) OR EXISTS (SELECT 1 FROM hop WHERE hop.a = p.b AND hop.b = p.a) AS same_path FROM p""")
def g10_same_path_giant(t: Tables):
    """Paths of at most two wins in a giant component: the index and the search from both ends."""
    e = scratch(graph.edges(t.tiers))
    ids = e.select(F.col("winner").alias("a")).distinct().withColumn("i", F.substring("a", 5, 8).cast("long"))
    p = ids.select("a", F.explode(F.array(*[F.col("i") + k for k in (1, 3, 50)])).alias("i")).join(ids.select("i", F.col("a").alias("b")), "i").select("a", "b")
    return graph.same_path(p, e, graph.components(graph.universe(e), e), depth=2, index=graph.reach_index(e, 2))


@query(f"WITH {_EDGES} SELECT other, side FROM (SELECT loser AS other, 'worse' AS side FROM edges WHERE winner = 'img_00000010' UNION SELECT winner, 'better' FROM edges WHERE loser = 'img_00000010')", "dag")
def g11_links_of(t: Tables):
    return graph.links_of(_edges(t), "img_00000010")


@query(f"WITH {_REACH} SELECT * FROM labels", "dag", recursive=True)
def g12_incremental_components(t: Tables):
    """The links of one of the two neighbours first, then all as new ones."""
    e = _edges(t)
    old = e.groupBy("winner").agg(F.min("loser").alias("loser"))
    return graph.merge_edges(graph.components(graph.universe(old), old), e)


@query(f"WITH {_REACH}, p AS (SELECT winner AS a, 'img_00000500' AS b FROM edges UNION SELECT 'nobody', 'img_00000500') SELECT p.a, p.b, x.component = y.component AS same FROM p LEFT JOIN labels x ON x.node = p.a LEFT JOIN labels y ON y.node = p.b", "dag", recursive=True)
def g20_same_component(t: Tables):
    p = _edges(t).select(F.col("winner").alias("a")).distinct().union(t.spark.range(1).select(F.lit("nobody").alias("a"))).withColumn("b", F.lit("img_00000500"))
    return graph.same_component(p, _labels(t))


@query(f"WITH {_EDGES} SELECT winner, loser FROM edges WHERE winner IN (SELECT filename FROM images WHERE score BETWEEN 0.1 AND 0.9) AND loser IN (SELECT filename FROM images WHERE score BETWEEN 0.1 AND 0.9)", "dag", "images")
def j12_surviving_edges(t: Tables):
    e = _edges(t)
    return graph.surviving_edges(e, t.images.where("score between 0.1 and 0.9").select(F.col("filename").alias("node")))


@query(f"""WITH {_REACH}, tops AS (SELECT node, component, lead(node) OVER (PARTITION BY component ORDER BY node) AS other FROM labels WHERE node NOT IN (SELECT loser FROM edges))
SELECT node AS a, other AS b FROM tops WHERE other IS NOT NULL""", "dag", recursive=True)
def g13_collapsible_pairs(t: Tables):  # two tops are never on a common path
    e, labels = _edges(t), _labels(t)
    ends = scratch(graph.extremes(None, e), "ends")
    tops = ends.where("is_top").join(labels, "node")
    p = tops.select(F.col("node").alias("a"), F.lead("node").over(W.partitionBy("component").orderBy("node")).alias("b")).where("b is not null")
    return graph.collapsible_pairs(p, ends, labels)


def cdf_sql(x: str) -> str:
    """The normal distribution function in SQL, by its power series (for arguments within some 6)."""
    return f"(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 90), lambda n: pow({x}, 2 * n + 1) * sqrt(pi()) / (pow(2.0, n + 1) * gamma(n + 1.5)))))"


def replay_sql(rows: str, last: str) -> str:
    """Recursive SQL after the ratings of `rows` (id, winner, loser) in order of id; `last` reads from rated (filename, mu, sigma, n).

    Each image waits with its rating at its next comparison; one at which both wait is carried out. So the recursion has as many steps as
    comparisons depend on each other, and needs nothing but the rows of the step before.
    """
    return f"""r AS ({rows}), sides AS (SELECT id, winner AS f, true AS won FROM r UNION ALL SELECT id, loser, false FROM r),
turns AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY id) AS k FROM sides),
wait(f, k, id, won, mu, sigma) AS (
  SELECT f, k, id, won, CAST(25 AS DOUBLE), CAST(25 AS DOUBLE) / 3 FROM turns WHERE k = 1
  UNION ALL
  SELECT s.f, CASE WHEN s.two = 2 THEN s.k + 1 ELSE s.k END, CASE WHEN s.two = 2 THEN t.id ELSE s.id END, CASE WHEN s.two = 2 THEN t.won ELSE s.won END,
         CASE WHEN s.two < 2 THEN s.mu WHEN s.won THEN s.mu + s.vw / sqrt(s.c2) * s.v ELSE s.mu - s.vl / sqrt(s.c2) * s.v END,
         CASE WHEN s.two < 2 THEN s.sigma WHEN s.won THEN sqrt(s.vw * greatest(1 - s.vw / s.c2 * s.v * (s.v + s.x), 1e-9)) ELSE sqrt(s.vl * greatest(1 - s.vl / s.c2 * s.v * (s.v + s.x), 1e-9)) END
  FROM (SELECT *, exp(-x * x / 2) / sqrt(2 * pi()) / {cdf_sql("x")} AS v FROM (SELECT *, (mw - ml) / sqrt(c2) AS x FROM (SELECT *, 2 * (25.0 / 6) ** 2 + vw + vl AS c2 FROM (
    SELECT *, count(*) OVER w AS two, max(CASE WHEN won THEN mu END) OVER w AS mw, max(CASE WHEN NOT won THEN mu END) OVER w AS ml,
      greatest(max(CASE WHEN won THEN sigma END) OVER w, 1e-9) ** 2 + (25.0 / 300) ** 2 AS vw, greatest(max(CASE WHEN NOT won THEN sigma END) OVER w, 1e-9) ** 2 + (25.0 / 300) ** 2 AS vl
    FROM wait WHERE id IS NOT NULL WINDOW w AS (PARTITION BY id))))) s
  LEFT JOIN turns t ON t.f = s.f AND t.k = s.k + 1
), rated AS (SELECT f AS filename, mu, sigma, k - 1 AS n FROM wait WHERE id IS NULL)
{last}"""


def replay_query(view: str, rows: str, last: str) -> str:
    return f"WITH RECURSIVE {ctes(*view.split())}, {replay_sql(rows, last)}"


_DAG_ROWS = "SELECT id, winner, filename_b AS loser FROM dag"
_RATED = "round(mu, 6) AS mu, round(sigma, 6) AS sigma, n"
_PUBLIC = "1.5 * (mu - 25) / sqrt(2 * (25.0 / 6) ** 2 + sigma ** 2 + (25.0 / 3) ** 2)"


def _rounded(ratings):
    return ratings.select("filename", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "n")


@query("SELECT filename, count(*) AS n FROM (SELECT filename_a AS filename FROM comparisons UNION ALL SELECT filename_b FROM comparisons) GROUP BY filename", "comparisons")
def r02_replay_counts(t: Tables):
    """The comparison counts of the fold."""
    return rating.replay(t.comparisons).select("filename", "n")


@query(replay_query("dag", _DAG_ROWS, f"SELECT filename, {_RATED} FROM rated"))
def r02_replay(t: Tables):
    """Many small components."""
    return _rounded(rating.replay(t.dag))


@query(replay_query("comparisons", "SELECT id, winner, CASE WHEN winner = filename_a THEN filename_b ELSE filename_a END AS loser FROM comparisons WHERE filename_a <> filename_b", f"SELECT filename, {_RATED} FROM rated"))
def r02_replay_giant(t: Tables):
    """Nearly all comparisons are one component, which is cut into windows of the order."""
    return _rounded(rating.replay(t.comparisons.where("filename_a <> filename_b"), limit=20_000))


@query(replay_query("comparisons", "SELECT -id AS id, winner, CASE WHEN winner = filename_a THEN filename_b ELSE filename_a END AS loser FROM comparisons WHERE filename_a <> filename_b", f"SELECT filename, {_RATED} FROM rated"))
def r02_replay_reversed(t: Tables):
    return _rounded(rating.replay(t.comparisons.where("filename_a <> filename_b"), "reverse", limit=20_000))


@query(replay_query("images dag", _DAG_ROWS, f"""SELECT i.filename, round(coalesce(mu, 25), 6) AS rating_mu, round(coalesce(sigma, CAST(25 AS DOUBLE) / 3), 6) AS rating_sigma, CAST(coalesce(n, 0) AS INT) AS comparison_count,
round(CASE WHEN mu IS NULL THEN 0.5 ELSE {cdf_sql(_PUBLIC)} END, 6) AS score, i.last_compared_at FROM images i LEFT JOIN rated USING (filename)"""))
def r03_recompute(t: Tables):
    out = rating.recompute(t.images, t.dag)
    return out.select("filename", *[F.round(c, 6).alias(c) for c in ("rating_mu", "rating_sigma", "score")], "comparison_count", "last_compared_at")


@query(replay_query("dag", """SELECT id, winner, filename_b AS loser FROM dag WHERE filename_a IN (SELECT f FROM often) AND filename_b IN (SELECT f FROM often)""", f"SELECT filename, {_RATED} FROM rated").replace(
    ", r AS (", ", often AS (SELECT f FROM (SELECT filename_a AS f FROM dag UNION ALL SELECT filename_b FROM dag) GROUP BY f HAVING count(*) >= 3), r AS (", 1))
def r05_subset_replay(t: Tables):
    return _rounded(rating.subset(t.dag.withColumns({"timestamp": F.lit(None).cast("timestamp"), "transitive_depth": F.lit(0)}), 3))


@query(replay_query("dag", _DAG_ROWS, f"SELECT filename, round({cdf_sql(_PUBLIC)}, 6) AS score, round(mu - 3 * sigma, 6) AS conservative, n FROM rated"))
def r06_scores(t: Tables):
    return rating.scores(rating.replay(t.dag)).select("filename", F.round("score", 6).alias("score"), F.round("conservative", 6).alias("conservative"), "n")


_ONE = f"""WITH a AS (SELECT filename, rating_mu AS m, greatest(rating_sigma, 1e-9) ** 2 + (25.0 / 300) ** 2 AS vw, (25.0 / 3) ** 2 + (25.0 / 300) ** 2 AS vl FROM images),
b AS (SELECT *, 2 * (25.0 / 6) ** 2 + vw + vl AS c2 FROM a), c AS (SELECT *, sqrt(c2) AS c, (m - 25) / sqrt(c2) AS x FROM b),
d AS (SELECT *, exp(-x * x / 2) / sqrt(2 * pi()) / {cdf_sql("x")} AS v FROM c)
SELECT filename, round(m + vw / c * v, 6) AS new_mu_w, round(sqrt(vw * greatest(1 - vw / c2 * v * (v + x), 1e-9)), 6) AS new_sigma_w,
round(25 - vl / c * v, 6) AS new_mu_l, round(sqrt(vl * greatest(1 - vl / c2 * v * (v + x), 1e-9)), 6) AS new_sigma_l FROM d"""


@query(_ONE, "images")
def r01_single_update(t: Tables):
    i = t.images.select("filename", "rating_mu", "rating_sigma")
    return i.select("filename", *[F.round(c, 6).alias(n) for n, c in rating_math.update_columns(F.col("rating_mu"), F.col("rating_sigma"), F.lit(25.0), F.lit(25.0 / 3)).items()])


@query(f"SELECT filename, round({cdf_sql('x')}, 8) AS p, round(exp(-x * x / 2) / sqrt(2 * pi()), 8) AS density, round(sqrt(s * s + (25.0 / 300) ** 2), 8) AS noisy FROM (SELECT filename, (rating_mu - 25) / 2 AS x, rating_sigma AS s FROM images)", "images")
def f11_f12_f16_normal(t: Tables):
    x = (F.col("rating_mu") - 25) / 2
    return t.images.select("filename", F.round(rating_math.normal_cdf(x), 8).alias("p"), F.round(rating_math.normal_pdf(x), 8).alias("density"), F.round(rating_math.with_noise(F.col("rating_sigma")), 8).alias("noisy"))


@query(f"SELECT filename, round({cdf_sql('1.5 * (rating_mu - 25) / sqrt(2 * (25.0 / 6) ** 2 + rating_sigma ** 2 + (25.0 / 3) ** 2)')}, 8) AS score FROM images", "images")
def f14_public_score(t: Tables):
    return t.images.select("filename", F.round(rating_math.public_score(F.col("rating_mu"), F.col("rating_sigma")), 8).alias("score"))


_RECORD = f"""WITH new AS (SELECT 'img_00000010' AS w, 'img_00000007' AS l),
a AS (SELECT w.filename AS wf, l.filename AS lf, w.comparison_count AS wn, l.comparison_count AS ln, w.rating_mu AS mw, l.rating_mu AS ml, greatest(w.rating_sigma, 1e-9) ** 2 + (25.0 / 300) ** 2 AS vw, greatest(l.rating_sigma, 1e-9) ** 2 + (25.0 / 300) ** 2 AS vl
FROM new JOIN images w ON w.filename = new.w JOIN images l ON l.filename = new.l), b AS (SELECT *, 2 * (25.0 / 6) ** 2 + vw + vl AS c2 FROM a), c AS (SELECT *, sqrt(c2) AS c, (mw - ml) / sqrt(c2) AS x FROM b),
d AS (SELECT *, exp(-x * x / 2) / sqrt(2 * pi()) / {cdf_sql("x")} AS v FROM c),
e AS (SELECT wf AS filename, wn + 1 AS n, mw + vw / c * v AS mu, sqrt(vw * greatest(1 - vw / c2 * v * (v + x), 1e-9)) AS sigma FROM d UNION ALL SELECT lf, ln + 1, ml - vl / c * v, sqrt(vl * greatest(1 - vl / c2 * v * (v + x), 1e-9)) FROM d)
SELECT filename, CAST(n AS INT) AS comparison_count, round(mu, 6) AS rating_mu, round(sigma, 6) AS rating_sigma, round({cdf_sql('1.5 * (mu - 25) / sqrt(2 * (25.0 / 6) ** 2 + sigma ** 2 + (25.0 / 3) ** 2)')}, 6) AS score FROM e"""


def _recorded(t: Tables):
    new = t.spark.range(1).select(F.lit("img_00000010").alias("filename_a"), F.lit("img_00000007").alias("filename_b"), F.lit("img_00000010").alias("winner"), F.lit(1.0).alias("weight"), F.lit(0).alias("transitive_depth"), F.lit("2030-01-01").cast(t.comparisons.schema["timestamp"].dataType).alias("timestamp"))
    return live.record(t.images, t.comparisons, new)


@query(_RECORD, "images")
def r04_record(t: Tables):
    """What a recorded comparison makes of the two images."""
    s = _recorded(t).sync
    return s.select("filename", "comparison_count", *[F.round(c, 6).alias(c) for c in ("rating_mu", "rating_sigma", "score")])


@query("SELECT id, filename_a, filename_b, winner FROM comparisons UNION ALL SELECT max(id) + 1, 'img_00000007', 'img_00000010', 'img_00000010' FROM comparisons", "comparisons")
def r04_appended(t: Tables):
    return _recorded(t).comparisons.select("id", "filename_a", "filename_b", "winner")


@query("SELECT filename, score FROM images ORDER BY comparison_count DESC, filename LIMIT (SELECT greatest(1, count(*) * 5 // 100) FROM images)", "images")
def w08_seed_pool(t: Tables):
    return pairing.seed_pool(pairing.candidates(t.images), t.images.count()).select("filename", "score")


@query("""WITH known AS (SELECT DISTINCT filename_a, filename_b FROM comparisons), c AS (SELECT filename, row_number() OVER (ORDER BY comparison_count, filename) AS r FROM images)
SELECT a.filename AS a, b.filename AS b, 'fallback' AS phase FROM c a JOIN c b ON a.r < b.r WHERE NOT EXISTS (SELECT 1 FROM known WHERE filename_a = least(a.filename, b.filename) AND filename_b = greatest(a.filename, b.filename))
ORDER BY a.r, b.r LIMIT 1""", "images")
def q08_fallback(t: Tables):
    return pairing.fallback(pairing.candidates(t.images), tables.link_set(t.comparisons))


@query("""WITH c AS (SELECT filename, rating_mu - 3 * rating_sigma AS skill, rating_sigma AS sigma, CAST(comparison_count % 9 AS INT) AS n FROM images), links AS (SELECT DISTINCT filename_a, filename_b FROM comparisons),
size AS (SELECT count(*) * 5 // 100 AS k FROM c), ready AS (SELECT count(*) AS m FROM (SELECT * FROM c ORDER BY n DESC, filename LIMIT (SELECT greatest(1, k) FROM size)) WHERE n >= 10),
under AS (SELECT *, row_number() OVER (ORDER BY n DESC, filename) AS r FROM c WHERE n < 10), one AS (SELECT * FROM under WHERE r = 1),
p AS (SELECT one.filename AS a, u.filename AS b, abs(one.skill - u.skill) AS gap, one.sigma FROM one, under u, size, ready WHERE m < k AND u.r > 1 AND u.r <= 1 + k - m AND u.n <= one.n + 2
AND NOT EXISTS (SELECT 1 FROM links WHERE filename_a = least(one.filename, u.filename) AND filename_b = greatest(one.filename, u.filename)))
SELECT a, b, 'seed_coverage' AS phase FROM p ORDER BY gap <= sigma DESC, CASE WHEN gap <= sigma THEN -gap ELSE gap END, a, b LIMIT 1""", "images")
def q01_seed_coverage(t: Tables):
    i = t.images.withColumn("comparison_count", (F.col("comparison_count") % 9).cast("int"))
    return pairing.seed_coverage(pairing.candidates(i), tables.link_set(t.comparisons), i.count())


@query()
def q02_anchor_insert(t: Tables):
    i = t.images.withColumn("comparison_count", (F.col("comparison_count") % 8).cast("int"))
    cand = _candidates(i)
    return pairing.anchor_insert(cand, tables.link_set(_dag(t)), cand.count(), _edges(t))


@query()
def q04_collapsible(t: Tables):
    return pairing.collapsible(_candidates(t.images), _chains(t), _dag(t))


@query("""WITH e AS (SELECT DISTINCT winner, filename_b AS loser FROM dag), ones AS (SELECT winner AS f, count(*) AS k FROM e GROUP BY 1 HAVING count(*) = 1),
few AS (SELECT filename, rating_mu - 3 * rating_sigma AS skill, rating_sigma AS sigma, comparison_count AS n FROM images WHERE comparison_count > 1 AND filename IN (SELECT f FROM ones) ORDER BY filename LIMIT 101),
p AS (SELECT *, row_number() OVER (ORDER BY gap, place) AS r FROM (SELECT row_number() OVER w AS place, filename AS a, lead(filename) OVER w AS b, abs(skill - lead(skill) OVER w) AS gap, sigma FROM few WINDOW w AS (ORDER BY n, filename)) WHERE b IS NOT NULL),
walk(r, a, b, gap, sigma) AS (SELECT r, a, b, gap, sigma FROM p WHERE r = 1
  UNION ALL SELECT p.r, CASE WHEN p.gap > w.gap THEN p.a ELSE w.a END, CASE WHEN p.gap > w.gap THEN p.b ELSE w.b END, greatest(p.gap, w.gap), CASE WHEN p.gap > w.gap THEN p.sigma ELSE w.sigma END FROM walk w JOIN p ON p.r = w.r + 1 WHERE p.gap <= w.sigma)
SELECT a, b, 'single_win_loss' AS phase FROM walk ORDER BY r DESC LIMIT 1""", "dag", "images", recursive=True)
def q05_single_win_loss(t: Tables):
    return pairing.single_win_loss(pairing.candidates(t.images), _edges(t))


@query()
def q06_chain_merge(t: Tables):
    return pairing.chain_merge(_candidates(t.images), _chains(t), _edges(t), graph.chain_labels(_chains(t)))


@query(f"""WITH {_EDGES}, ranked AS (SELECT *, row_number() OVER (ORDER BY comparison_count DESC, filename) AS r, count(*) OVER () AS total FROM images),
seeds AS (SELECT * FROM ranked WHERE r <= greatest(1, total * 5 // 100)),
one AS (SELECT * FROM ranked WHERE comparison_count > 1 AND rating_sigma >= 3.0 AND filename NOT IN (SELECT filename FROM seeds) ORDER BY rating_sigma DESC, filename LIMIT 1),
near AS (SELECT one.filename AS a, s.filename AS b, abs(one.rating_mu - s.rating_mu) AS g FROM one, seeds s WHERE s.comparison_count > 1 AND NOT EXISTS (SELECT 1 FROM edges e WHERE least(e.winner, e.loser) = least(one.filename, s.filename) AND greatest(e.winner, e.loser) = greatest(one.filename, s.filename))),
hop(a, b, d) AS (SELECT filename, filename, 0 FROM one UNION SELECT h.a, e.loser, h.d + 1 FROM hop h JOIN edges e ON e.winner = h.b WHERE h.d < 5),
rise(a, b, d) AS (SELECT filename, filename, 0 FROM one UNION SELECT h.a, e.winner, h.d + 1 FROM rise h JOIN edges e ON e.loser = h.b WHERE h.d < 5)
SELECT a, b, 'uncertainty' AS phase FROM near WHERE b NOT IN (SELECT b FROM hop) AND b NOT IN (SELECT b FROM rise) ORDER BY g, b LIMIT 1""", "dag", "images", recursive=True)
def q07_uncertainty(t: Tables):
    cand = _candidates(t.images)
    return pairing.uncertainty(cand, tables.link_set(_dag(t)), cand.count(), _edges(t))


@query()
def q09_q10_next_pair(t: Tables):
    return pairing.next_pair(t.images, t.dag, t.images.where("score > 0.99").select("filename"))


@query(f"""{_DAG} SELECT filename, round(score, 4) AS score, round(rating_mu, 4) AS mu, round(rating_sigma, 4) AS sigma, comparison_count, coalesce(w.n, 0) AS wins, coalesce(l.n, 0) AS losses, component, coalesce(height, 1) AS height
FROM images i LEFT JOIN (SELECT winner, count(*) AS n FROM edges GROUP BY 1) w ON w.winner = filename LEFT JOIN (SELECT loser, count(*) AS n FROM edges GROUP BY 1) l ON l.loser = filename
LEFT JOIN labels ON labels.node = filename LEFT JOIN heights ON heights.node = filename""", "dag", "images", recursive=True)
def q12_describe(t: Tables):
    return pairing.describe(t.images, tallies(_edges(t)), None, graph.placed(_chains(t)))

