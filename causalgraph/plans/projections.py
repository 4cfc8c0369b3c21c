"""Graphs seen in relational tables.

The projections are SQL that Spark and other engines read alike; all ranks are over
integers, so that every engine picks the same edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import confidence
from ..graph import CausalGraph
from .iterate import slices

TRADE_NODES = """
SELECT 'N' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS id, n_name AS label,
       CASE n_nationkey % 4 WHEN 0 THEN 'STOCK' WHEN 1 THEN 'STATE' WHEN 2 THEN 'BOUNDARY' ELSE 'PROCESS' END AS category,
       CASE n_nationkey % 3 WHEN 0 THEN 'Cell' WHEN 1 THEN 'regulator' ELSE 'protein' END AS subtype,
       'R' || CAST(n_regionkey AS STRING) AS module_id, n_name || ' in region ' || CAST(n_regionkey AS STRING) AS description,
       CASE WHEN n_nationkey % 5 = 0 THEN 'THERAPEUTIC_TARGET' WHEN n_nationkey % 7 = 0 THEN 'BIOMARKER' WHEN n_nationkey % 3 = 1 THEN 'REGULATOR' ELSE '' END AS role,
       CAST(n_nationkey AS BIGINT) AS ord FROM nation"""

TRADE_EDGES = """
SELECT 'E' || lpad(CAST(a AS STRING), 2, '0') || '_' || lpad(CAST(b AS STRING), 2, '0') AS id,
       'N' || lpad(CAST(a AS STRING), 2, '0') AS source, 'N' || lpad(CAST(b AS STRING), 2, '0') AS target,
       CASE n % 4 WHEN 0 THEN 'increases' WHEN 1 THEN 'decreases' WHEN 2 THEN 'regulates' ELSE 'inhibits' END AS relation,
       'R' || CAST(a % 5 AS STRING) AS module_id, 'L' || CAST(1 + n % 7 AS STRING) AS causal_confidence,
       CASE WHEN n % 3 = 0 THEN NULL WHEN n % 5 = 0 THEN '' ELSE CAST(10000 + n AS STRING) END AS pmid,
       CASE WHEN n % 4 = 1 THEN NULL ELSE 'Author' || CAST(n % 6 AS STRING) END AS first_author,
       CASE WHEN n % 6 = 1 THEN NULL ELSE CAST(1990 + n % 30 AS INT) END AS year,
       CASE n % 8 WHEN 0 THEN 'RCT' WHEN 1 THEN 'knockout' WHEN 2 THEN 'in_vitro' WHEN 3 THEN 'cohort' WHEN 4 THEN 'review' WHEN 5 THEN 'rct' WHEN 6 THEN 'GWAS' END AS method_type,
       CASE WHEN n % 9 = 0 THEN NULL ELSE 'flow of ' || CAST(n AS STRING) END AS mechanism_description,
       CAST(n AS BIGINT) AS volume, CAST(a * 100 + b AS BIGINT) AS ord
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rk FROM (
  SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey) AS flow) AS ranked WHERE rk <= 3"""

_RANK = "CAST(substr(causal_confidence, 2) AS INT)"
_STRENGTH = "CASE causal_confidence " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in confidence.DEFAULT_WEIGHTS.items()) + " END"
#: Common table expressions `nodes` and `edges` of the trade graph, for SQL that states what an operator gives.
TRADE_CTE = f"""nodes AS ({TRADE_NODES}),
edges0 AS ({TRADE_EDGES}),
edges AS (SELECT *, {_RANK} AS conf_rank, {_STRENGTH} AS strength, 1.0 / {_STRENGTH} AS distance,
  relation IN ({", ".join(f"'{r}'" for r in confidence.INHIBITORY)}) AS is_inhibitory FROM edges0)"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _over(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Run portable SQL over the Parquet tables it names."""
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
    return spark.sql(sql)


def trade(spark: SparkSession, sf_dir: str) -> CausalGraph:
    """Nations, joined by their three largest flows of goods each; modules are regions."""
    nodes = _over(spark, sf_dir, TRADE_NODES, "nation")
    nodes = nodes.withColumn("roles", F.when(F.col("role") != "", F.array("role")).otherwise(F.array().cast("array<string>"))).drop("role")
    edges = _over(spark, sf_dir, TRADE_EDGES, "lineitem", "orders", "customer", "supplier")
    modules = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"))
    return CausalGraph(nodes, edges, modules)


SUPPLY_NODES = """
SELECT 'S' || CAST(s_suppkey AS STRING) AS id, 'n' || CAST(s_nationkey AS STRING) AS module_id FROM supplier
UNION ALL SELECT 'P' || CAST(p_partkey AS STRING) AS id, p_brand AS module_id FROM part"""
SUPPLY_EDGES = "SELECT DISTINCT 'S' || CAST(l_suppkey AS STRING) AS source, 'P' || CAST(l_partkey AS STRING) AS target FROM lineitem"


def supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of suppliers and the parts they have shipped.

    Pairs hardly repeat, so they are made distinct (SUPPLY_EDGES) where those of a
    supplier meet, in tasks of bounded size, and not before.
    """
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = line.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target"))
    return _over(spark, sf_dir, SUPPLY_NODES, "supplier", "part"), pairs.repartition(slices(line.count()), "source").distinct()


HIERARCHY_EDGES = """
SELECT 'r' || CAST(n_regionkey AS STRING) AS source, 'n' || CAST(n_nationkey AS STRING) AS target FROM nation
UNION ALL SELECT 'n' || CAST(c_nationkey AS STRING), 'c' || CAST(c_custkey AS STRING) FROM customer
UNION ALL SELECT 'c' || CAST(o_custkey AS STRING), 'o' || CAST(o_orderkey AS STRING) FROM orders
UNION ALL SELECT 'r' || CAST(n_regionkey AS STRING), 'c' || CAST(c_custkey AS STRING) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 = 0"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(source, target) of region, nation, customer and order: an acyclic graph with long spans."""
    return _over(spark, sf_dir, HIERARCHY_EDGES, "nation", "customer", "orders")


EVENT_EDGES = """
SELECT event_type AS source, following AS target, count(*) AS n FROM (
  SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events) AS x
WHERE following IS NOT NULL GROUP BY event_type, following"""


def event_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(source, target, n): how often one type of event follows another of the same user."""
    return _over(spark, sf_dir, EVENT_EDGES, "events")
