"""The driver's tables seen as a property graph, and as other inputs of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}::"), F.col(column).cast("string"))


def gnodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, grp."""
    parts = [
        ("region", "Package", _id("region", "r_regionkey"), F.col("r_name"), F.lit(None).cast("string")),
        ("nation", "Module", _id("nation", "n_nationkey"), F.col("n_name"), _id("region", "n_regionkey")),
        ("customer", "Class", _id("cust", "c_custkey"), F.concat("c_mktsegment", F.lit("."), "c_name"), _id("nation", "c_nationkey")),
        ("supplier", "Interface", _id("supp", "s_suppkey"), F.col("s_name"), _id("nation", "s_nationkey")),
        ("orders", "Function", _id("ord", "o_orderkey"), F.col("o_orderpriority"), _id("cust", "o_custkey")),
        ("part", "Type", _id("part", "p_partkey"), F.col("p_name"), F.lit(None).cast("string")),
    ]
    out = None
    for name, kind, i, label, grp in parts:
        rows = table(spark, sf_dir, name).select(i.alias("id"), F.lit(kind).alias("kind"), label.alias("name"), grp.alias("grp"))
        out = rows if out is None else out.unionByName(rows)
    return out


def gedges(spark: SparkSession, sf_dir: str, *relations: str) -> DataFrame:
    """edge_id, src, dst, relation; only the tables of the relations asked for are read."""
    t = lambda name: table(spark, sf_dir, name)
    following = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    made = {
        "CONTAINS": lambda: [
            t("nation").select(_id("region", "n_regionkey").alias("src"), _id("nation", "n_nationkey").alias("dst")),
            t("customer").select(_id("nation", "c_nationkey").alias("src"), _id("cust", "c_custkey").alias("dst")),
            t("orders").select(_id("cust", "o_custkey").alias("src"), _id("ord", "o_orderkey").alias("dst")),
        ],
        "USES": lambda: [t("lineitem").select(_id("ord", "l_orderkey").alias("src"), _id("part", "l_partkey").alias("dst"))],
        "DEFINES": lambda: [t("lineitem").select("l_suppkey", "l_partkey").distinct().select(_id("supp", "l_suppkey").alias("src"), _id("part", "l_partkey").alias("dst"))],
        "CALLS": lambda: [
            t("orders").select(_id("ord", "o_orderkey").alias("src"), F.lead("o_orderkey").over(following).alias("n")).where("n IS NOT NULL").select("src", _id("ord", "n").alias("dst"))
        ],
    }
    out = None
    for relation in relations or made:
        for rows in made[relation]():
            rows = rows.withColumn("relation", F.lit(relation))
            out = rows if out is None else out.unionByName(rows)
    return out.select(F.xxhash64("src", "dst", "relation").alias("edge_id"), "src", "dst", "relation")


def trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, src, dst: which event type follows which, for some user."""
    following = W.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(following).alias("dst"))
    return pairs.where("dst IS NOT NULL").distinct().select(F.xxhash64("src", "dst").alias("edge_id"), "src", "dst")


#: The same projections for the oracle.
SQL = """
gnodes AS (
  SELECT 'region::' || r_regionkey AS id, 'Package' AS kind, r_name AS name, CAST(NULL AS VARCHAR) AS grp FROM region
  UNION ALL SELECT 'nation::' || n_nationkey, 'Module', n_name, 'region::' || n_regionkey FROM nation
  UNION ALL SELECT 'cust::' || c_custkey, 'Class', c_mktsegment || '.' || c_name, 'nation::' || c_nationkey FROM customer
  UNION ALL SELECT 'supp::' || s_suppkey, 'Interface', s_name, 'nation::' || s_nationkey FROM supplier
  UNION ALL SELECT 'ord::' || o_orderkey, 'Function', o_orderpriority, 'cust::' || o_custkey FROM orders
  UNION ALL SELECT 'part::' || p_partkey, 'Type', p_name, NULL FROM part),
calls AS (
  SELECT 'ord::' || o_orderkey AS src, 'ord::' || n AS dst FROM (
    SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n IS NOT NULL),
contains_ AS (
  SELECT 'region::' || n_regionkey AS src, 'nation::' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation::' || c_nationkey, 'cust::' || c_custkey FROM customer
  UNION ALL SELECT 'cust::' || o_custkey, 'ord::' || o_orderkey FROM orders),
uses AS (SELECT 'ord::' || l_orderkey AS src, 'part::' || l_partkey AS dst FROM lineitem),
defines AS (SELECT DISTINCT 'supp::' || l_suppkey AS src, 'part::' || l_partkey AS dst FROM lineitem),
gedges AS (
  SELECT src, dst, 'CONTAINS' AS relation FROM contains_ UNION ALL SELECT src, dst, 'USES' FROM uses
  UNION ALL SELECT src, dst, 'DEFINES' FROM defines UNION ALL SELECT src, dst, 'CALLS' FROM calls),
trans AS (
  SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
  WHERE dst IS NOT NULL)
"""
