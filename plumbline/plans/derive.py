"""Pairs of sides derived from the given tables, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as texts, but for the key."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"),
        F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"), "o_orderpriority",
    )


def _changed(l: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return l.select(
        "o_orderkey", "o_custkey", F.when(k % 13 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 == 0, (F.col("o_totalprice").cast("decimal(18,2)") + 1).cast("decimal(18,2)").cast("string")).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate", F.when(k % 17 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


def right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with keys dropped and added and cells changed, by fixed rules on the key."""
    l = left(spark, sf_dir)
    added = l.filter("o_orderkey % 50 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return _changed(l.filter("o_orderkey % 11 <> 0")).unionByName(added)


L_SQL = """l AS (SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_totalprice::DECIMAL(18,2)::VARCHAR AS o_totalprice, o_orderdate::DATE::VARCHAR AS o_orderdate, o_orderpriority FROM orders)"""
R_SQL = """r AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN (o_totalprice::DECIMAL(18,2) + 1)::DECIMAL(18,2)::VARCHAR ELSE o_totalprice END AS o_totalprice, o_orderdate,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS o_orderpriority FROM l WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM l WHERE o_orderkey % 50 = 0)"""
SIDES = f"WITH {L_SQL}, {R_SQL}"

LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_price", "l_returnflag", "l_shipdate"]
LINE_KEYS = ["l_orderkey", "l_linenumber"]


def line_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEYS, F.col("l_partkey").cast("string").alias("l_partkey"), F.col("l_suppkey").cast("string").alias("l_suppkey"), F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("l_quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("l_price"), "l_returnflag", F.col("l_shipdate").cast("date").cast("string").alias("l_shipdate"),
    )


def line_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = line_left(spark, sf_dir).filter("l_orderkey % 11 <> 0")
    return l.withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 == 0, (F.col("l_quantity").cast("decimal(18,2)") + 1).cast("decimal(18,2)").cast("string")).otherwise(F.col("l_quantity"))).withColumn("l_returnflag", F.when(F.col("l_orderkey") % 13 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")))


LINE_SQL = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS l_partkey, l_suppkey::VARCHAR AS l_suppkey, l_quantity::DECIMAL(18,2)::VARCHAR AS l_quantity,
    l_extendedprice::DECIMAL(18,2)::VARCHAR AS l_price, l_returnflag, l_shipdate::DATE::VARCHAR AS l_shipdate FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 7 = 0 THEN (l_quantity::DECIMAL(18,2) + 1)::DECIMAL(18,2)::VARCHAR ELSE l_quantity END AS l_quantity, l_price,
    CASE WHEN l_orderkey % 13 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS l_returnflag, l_shipdate FROM l WHERE l_orderkey % 11 <> 0)"""
LINE_ORDER = "l_partkey, l_suppkey, l_price, l_shipdate, l_quantity, l_returnflag"
