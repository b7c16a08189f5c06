"""Findings seen through order tables, so that every operator can be compared with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per order line. Join sides are left to the planner, which broadcasts by size."""
    line, orders, customer, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    f = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).join(part, line.l_partkey == part.p_partkey)
    level = F.substring("o_orderpriority", 1, 1)
    return f.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "p_brand", "p_type", "l_returnflag", "l_quantity", "l_extendedprice",
        F.when(level == "1", 4).when(level == "2", 3).when(level == "3", 2).when(level == "5", 1).otherwise(0).alias("impact"),
        (F.col("l_returnflag") == "R").alias("active"), (F.col("l_linestatus") == "O").alias("internet"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", 3).when(F.col("c_mktsegment") == "BUILDING", 2).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0).alias("crit"),
        F.round(F.col("l_discount") * 10, 2).alias("epss"), (F.col("l_quantity") >= 45).alias("mature"), (F.col("l_tax") >= 0.07).alias("strong"), (F.col("p_size") <= 3).alias("isolated"),
        F.when(F.col("o_orderstatus") == "O", "confirmed").when(F.col("o_orderstatus") == "F", "remediated").otherwise("accepted_risk").alias("disposition"),
    )


FINDINGS_SQL = """
f AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, p_brand, p_type, l_returnflag, l_quantity, l_extendedprice,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '5' THEN 1 ELSE 0 END AS impact,
    l_returnflag = 'R' AS active, l_linestatus = 'O' AS internet,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 3 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS crit,
    round(l_discount * 10, 2) AS epss, l_quantity >= 45 AS mature, l_tax >= 0.07 AS strong, p_size <= 3 AS isolated,
    CASE o_orderstatus WHEN 'O' THEN 'confirmed' WHEN 'F' THEN 'remediated' ELSE 'accepted_risk' END AS disposition
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
b AS (
  SELECT *, CASE WHEN impact >= 4 AND active AND internet AND crit >= 3 THEN 0
    WHEN (active AND impact >= 2 AND (internet OR crit >= 2)) OR (mature AND impact >= 3 AND (internet OR crit >= 3)) OR (epss >= 0.85 AND impact >= 3 AND (internet OR crit >= 3)) THEN 1
    WHEN (active AND impact >= 1 AND (internet OR crit >= 2 OR epss >= 0.5)) OR (mature AND impact >= 2 AND (internet OR crit >= 2)) OR (epss >= 0.5 AND impact >= 3)
      OR (impact >= 3 AND (internet OR crit >= 3)) OR (impact >= 2 AND (internet OR crit >= 2) AND (mature OR epss >= 0.2)) THEN 2
    WHEN impact >= 2 THEN 3 ELSE 4 END AS raw_rank FROM f),
c AS (SELECT *, CASE WHEN active THEN least(raw_rank, 2) ELSE raw_rank END AS base_rank FROM b),
d AS (SELECT *, (strong OR isolated) AND NOT (active OR internet OR mature OR epss >= 0.5) AND base_rank > 1 AS eased FROM c),
t AS (
  SELECT *, CASE WHEN eased THEN CASE WHEN crit >= 3 THEN 3 ELSE 4 END ELSE base_rank END AS tier_rank,
    'P' || CASE WHEN eased THEN CASE WHEN crit >= 3 THEN 3 ELSE 4 END ELSE base_rank END AS tier,
    CASE WHEN disposition = 'confirmed' THEN 'P' || CASE WHEN eased THEN CASE WHEN crit >= 3 THEN 3 ELSE 4 END ELSE base_rank END END AS effective FROM d)
"""
