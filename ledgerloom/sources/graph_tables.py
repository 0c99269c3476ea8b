"""A property graph derived from the star-schema tables: parts, suppliers, customers, orders, nations, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.tables import load


def _path(kind: str, column: str):
    return F.concat(F.lit(kind + "/"), F.col(column).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """path, title, type, status."""
    now = F.lit("current")
    parts = [
        load(spark, d, "part").select(_path("part", "p_partkey").alias("path"), F.col("p_name").alias("title"), F.lit("entity").alias("type"), now.alias("status")),
        load(spark, d, "supplier").select(_path("supplier", "s_suppkey"), "s_name", F.lit("institution"), now),
        load(spark, d, "customer").select(_path("customer", "c_custkey"), "c_name", F.lit("people"), now),
        load(spark, d, "orders").select(_path("order", "o_orderkey"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.lit("page"), F.when(F.col("o_orderstatus") == "F", "deprecated").otherwise("current")),
        load(spark, d, "nation").select(_path("nation", "n_nationkey"), "n_name", F.lit("hub"), now),
        load(spark, d, "region").select(_path("region", "r_regionkey"), "r_name", F.lit("hub"), now),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """alias, node_path: brand names of parts."""
    return load(spark, d, "part").select(F.col("p_brand").alias("alias"), _path("part", "p_partkey").alias("node_path")).distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """s, p, o, confidence."""
    sure = F.lit("traceable")
    lines = load(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    flag = F.max("l_returnflag")
    cites = lines.groupBy("l_orderkey", "l_partkey").agg(F.when(flag == "R", "traceable").when(flag == "N", "inferred").otherwise("doubtful").alias("confidence"))
    parts = [
        load(spark, d, "orders").select(_path("order", "o_orderkey").alias("s"), F.lit("placed_by").alias("p"), _path("customer", "o_custkey").alias("o"), sure.alias("confidence")),
        cites.select(_path("order", "l_orderkey"), F.lit("cites"), _path("part", "l_partkey"), "confidence"),
        lines.select("l_partkey", "l_suppkey").distinct().select(_path("part", "l_partkey"), F.lit("supplied_by"), _path("supplier", "l_suppkey"), sure),
        load(spark, d, "customer").select(_path("customer", "c_custkey"), F.lit("in"), _path("nation", "c_nationkey"), sure),
        load(spark, d, "supplier").select(_path("supplier", "s_suppkey"), F.lit("in"), _path("nation", "s_nationkey"), sure),
        load(spark, d, "nation").select(_path("nation", "n_nationkey"), F.lit("in"), _path("region", "n_regionkey"), sure),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def facts(spark: SparkSession, d: str) -> DataFrame:
    """subject, object, valid_from, valid_until: a customer's latest order is current until the next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = load(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return o.select(_path("customer", "o_custkey").alias("subject"), _path("order", "o_orderkey").alias("object"), F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_until"))


def write_graph(folder: str, nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> None:
    """A graph as tables in a new folder; edges lie by predicate, so a filter on it reads only its own."""
    nodes.write.mode("errorifexists").parquet(f"{folder}/nodes")
    aliases.write.mode("errorifexists").parquet(f"{folder}/aliases")
    edges.write.mode("errorifexists").partitionBy("p").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """nodes, edges and aliases of a stored graph, to be read only."""
    tables = {n: spark.read.parquet(f"{folder}/{n}") for n in ("nodes", "edges", "aliases")}
    return tables | {"edges": tables["edges"].select("s", "p", "o", "confidence")}


#: The same in SQL, to be put before a statement.
NODES_SQL = """nodes AS (
  SELECT 'part/' || p_partkey AS path, p_name AS title, 'entity' AS type, 'current' AS status FROM part
  UNION ALL SELECT 'supplier/' || s_suppkey, s_name, 'institution', 'current' FROM supplier
  UNION ALL SELECT 'customer/' || c_custkey, c_name, 'people', 'current' FROM customer
  UNION ALL SELECT 'order/' || o_orderkey, 'Order ' || o_orderkey, 'page', CASE WHEN o_orderstatus = 'F' THEN 'deprecated' ELSE 'current' END FROM orders
  UNION ALL SELECT 'nation/' || n_nationkey, n_name, 'hub', 'current' FROM nation
  UNION ALL SELECT 'region/' || r_regionkey, r_name, 'hub', 'current' FROM region)"""
EDGES_SQL = """edges AS (
  SELECT 'order/' || o_orderkey AS s, 'placed_by' AS p, 'customer/' || o_custkey AS o, 'traceable' AS confidence FROM orders
  UNION ALL SELECT 'order/' || l_orderkey, 'cites', 'part/' || l_partkey, CASE max(l_returnflag) WHEN 'R' THEN 'traceable' WHEN 'N' THEN 'inferred' ELSE 'doubtful' END FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'supplied_by', 'supplier/' || l_suppkey, 'traceable' FROM lineitem
  UNION ALL SELECT 'customer/' || c_custkey, 'in', 'nation/' || c_nationkey, 'traceable' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'in', 'nation/' || s_nationkey, 'traceable' FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'in', 'region/' || n_regionkey, 'traceable' FROM nation)"""
FACTS_SQL = """facts AS (
  SELECT 'customer/' || o_custkey AS subject, 'order/' || o_orderkey AS object, o_orderdate AS valid_from,
         lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_until FROM orders)"""
