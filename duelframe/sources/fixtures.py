"""The engine's tables, derived from the star-schema test tables.

Every statement is plain SQL that Spark and DuckDB both accept, so a query and its SQL twin start from the
same rows. Ids come from keys, not from a global row number, so no statement sorts a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_NAME = "concat('img_', lpad(CAST({0} AS STRING), 8, '0'))"
_PAIRS = """
  SELECT l_orderkey, l_partkey AS a, l_extendedprice AS pa, l_shipdate AS ts,
         row_number() OVER w AS rn, lead(l_partkey) OVER w AS b, lead(l_extendedprice) OVER w AS pb
  FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)
"""
COMPARISONS = f"""
SELECT l_orderkey * 100 + rn AS id, {_NAME.format("least(a, b)")} AS filename_a, {_NAME.format("greatest(a, b)")} AS filename_b,
       {_NAME.format("CASE WHEN pa >= pb THEN a ELSE b END")} AS winner, ts AS timestamp,
       CASE WHEN l_orderkey % 10 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS weight,
       CAST(0 AS INT) AS transitive_depth
FROM ({_PAIRS}) s WHERE b IS NOT NULL
"""
#: Each order against the next two of its customer; the dearer one wins, so there is no cycle.
DAG = f"""
SELECT DISTINCT w * 100000000 + l AS id, {_NAME.format("w")} AS filename_a, {_NAME.format("l")} AS filename_b, {_NAME.format("w")} AS winner,
       CAST(1.0 AS DOUBLE) AS weight
FROM (
  SELECT CASE WHEN p > q THEN k ELSE m END AS w, CASE WHEN p > q THEN m ELSE k END AS l FROM (
    SELECT o_orderkey AS k, o_totalprice AS p, lead(o_orderkey) OVER v AS m, lead(o_totalprice) OVER v AS q FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    UNION ALL
    SELECT o_orderkey, o_totalprice, lead(o_orderkey, 2) OVER v, lead(o_totalprice, 2) OVER v FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  ) near WHERE m IS NOT NULL AND p <> q
) e
"""
#: The same with ways back: of every fourth order of a customer, in time, to the one three before.
CYCLIC = f"""
SELECT DISTINCT w * 100000000 + l AS id, {_NAME.format("w")} AS filename_a, {_NAME.format("l")} AS filename_b, {_NAME.format("w")} AS winner, CAST(1.0 AS DOUBLE) AS weight
FROM (
  SELECT o_orderkey AS w, lead(o_orderkey) OVER v AS l FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  UNION ALL
  SELECT CASE WHEN n % 4 = 0 THEN o_orderkey END, back FROM (
    SELECT o_orderkey, row_number() OVER v AS n, lag(o_orderkey, 3) OVER v AS back FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  ) r
) e WHERE w IS NOT NULL AND l IS NOT NULL
"""
#: Parts of one order against each other, the one of the higher tier of seven by size wins: acyclic, nearly all one component.
TIERS = f"""
SELECT DISTINCT w * 100000000 + l AS id, {_NAME.format("w")} AS filename_a, {_NAME.format("l")} AS filename_b, {_NAME.format("w")} AS winner, CAST(1.0 AS DOUBLE) AS weight
FROM (
  SELECT CASE WHEN x.p_size % 7 > y.p_size % 7 THEN a ELSE b END AS w, CASE WHEN x.p_size % 7 > y.p_size % 7 THEN b ELSE a END AS l
  FROM ({_PAIRS}) s JOIN (SELECT p_partkey, p_size FROM part) x ON x.p_partkey = a JOIN (SELECT p_partkey, p_size FROM part) y ON y.p_partkey = b
  WHERE x.p_size % 7 <> y.p_size % 7
) e
"""
IMAGES = f"""
SELECT {_NAME.format("p_partkey")} AS filename, CAST(p_partkey % 1000 AS DOUBLE) / 1000 AS score,
       20 + CAST(p_partkey % 101 AS DOUBLE) / 10 AS rating_mu, 1 + CAST(p_partkey % 71 AS DOUBLE) / 10 AS rating_sigma,
       CAST(coalesce(c.n, 0) AS INT) AS comparison_count, c.last_t AS last_compared_at, CAST(0 AS INT) AS ranking_generation,
       lower(concat(p_name, ', ', p_brand, ', ', p_type)) AS prompt_tags
FROM part LEFT JOIN (
  SELECT f, count(*) AS n, max(t) AS last_t FROM (
    SELECT filename_a AS f, timestamp AS t FROM comparisons UNION ALL SELECT filename_b, timestamp FROM comparisons
  ) ends GROUP BY f
) c ON c.f = {_NAME.format("p_partkey")}
"""
PROMPTS = """
SELECT p_partkey AS id, concat('(', p_name, ':1.', CAST(p_size % 10 AS STRING), '), ', p_type, ' but ', p_brand) AS prompt FROM part
"""
#: One parameter record per order: id, score, and parameters as text.
RECORDS = """
SELECT o_orderkey AS id, CAST(o_orderkey % 997 AS DOUBLE) / 997 AS score, o_orderstatus AS sampler, o_orderpriority AS scheduler,
       CAST(1 + o_custkey % 50 AS INT) AS steps, CAST(o_custkey % 15 AS DOUBLE) / 2 AS cfg FROM orders
"""
#: Three slots of vectors by id, of which not every id has all.
SLOTS = """
SELECT 'size' AS vector_name, p_partkey AS id, CAST(p_size AS DOUBLE) AS v FROM part
UNION ALL SELECT 'price', p_partkey, p_retailprice FROM part WHERE p_size > 5
UNION ALL SELECT 'mean_quantity', l_partkey, avg(l_quantity) FROM lineitem GROUP BY l_partkey
"""
VIEWS = {"comparisons": COMPARISONS, "dag": DAG, "cyclic": CYCLIC, "tiers": TIERS, "images": IMAGES, "prompts": PROMPTS, "records": RECORDS, "slots": SLOTS}
_NEEDS = {"images": ("comparisons",)}
_TABLES = ("lineitem", "part", "orders")


def ctes(*names: str) -> str:
    """A WITH list that defines the named views, for the SQL twins."""
    order: list[str] = []
    for n in names:
        for m in (*_NEEDS.get(n, ()), n):
            if m not in order:
                order.append(m)
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)


def dag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of DAG before its DISTINCT, from one sort of the orders: for who wants different links only, so that a row is dealt once."""
    near = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    next_ = F.array(*[F.struct(F.lead("o_orderkey", n).over(near).alias("m"), F.lead("o_totalprice", n).over(near).alias("q")) for n in (1, 2)])
    pairs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), next_.alias("x")).select("k", "p", F.inline("x")).where("m IS NOT NULL AND p <> q")
    ends = pairs.selectExpr("CASE WHEN p > q THEN k ELSE m END AS w", "CASE WHEN p > q THEN m ELSE k END AS l")
    w, lo = _NAME.format("w"), _NAME.format("l")
    return ends.selectExpr("w * 100000000 + l AS id", f"{w} AS filename_a", f"{lo} AS filename_b", f"{w} AS winner", "CAST(1.0 AS DOUBLE) AS weight")


def _image_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f, n, t) of IMAGES' subquery, from one sort of the lines; they are counted by key before any name is made."""
    lines = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(lines).alias("b"), F.col("l_shipdate").alias("t")).where("b IS NOT NULL")
    by_key = pairs.select(F.explode(F.array(F.least("a", "b"), F.greatest("a", "b"))).alias("k"), "t").groupBy("k").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))
    return by_key.select(F.expr(_NAME.format("k")).alias("f"), "n", "last_t").groupBy("f").agg(F.sum("n").alias("n"), F.max("last_t").alias("last_t"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view; dag and images by plans that give the same rows as their statements with fewer exchanges."""
    if name == "dag":
        return dag_rows(spark, sf_dir).distinct()
    if name == "images":
        head, tail = IMAGES.split("LEFT JOIN (")[0], IMAGES.rsplit(") c ON", 1)[1]
        sql = f"{head.replace('FROM part', 'FROM {part}')}LEFT JOIN {{ends}} c ON{tail}"
        return spark.sql(sql, part=spark.read.parquet(f"{sf_dir}/part.parquet"), ends=_image_ends(spark, sf_dir))
    return as_stated(spark, sf_dir, name)


def as_stated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view by its statement."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    sql = f"WITH {ctes(name)} SELECT * FROM {name}"
    for t in _TABLES:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    used = {t: df for t, df in tables.items() if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)
