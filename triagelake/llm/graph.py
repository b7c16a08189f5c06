"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v; each node's neighbours are linked to its least neighbour."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, both.u == least.w)
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """node, root: the least node that each node of edges (a, b) can reach; nodes without links are absent.

    Each step is written to the shared folder and the one before is dropped. It ends when a pair of steps changes
    nothing; the number of steps grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path, sign = None, None
    for _ in range(most):
        step = _star(_star(now, True), False)
        new = scratch(spark, "star")
        step.write.parquet(new)
        now = spark.read.schema("u long, v long").parquet(new)
        if path:
            drop_path(spark, path)
        path = new
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == sign:
            break
        sign = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
