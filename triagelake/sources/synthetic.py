"""The deterministic corpus of the published timings, made where it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, count: int, parts: int = 8) -> DataFrame:
    """index and record (struct) of `count` synthetic findings: ten severity bands, 10,000 assets, 9,000 identifiers."""
    i = F.col("id")
    band = i % 10
    by = lambda top, high, medium, low: F.when(band == 0, top).when(band < 3, high).when(band < 7, medium).otherwise(low)
    word = by("Critical", "High", "Medium", "Low")
    padded = lambda n, width: F.lpad(n.cast("string"), width, "0")
    record = F.struct(
        F.concat(F.lit("synthetic-"), padded(i, 8)).alias("id"), F.format_string("Synthetic %s vulnerability %d", F.lower(word), i).alias("title"),
        F.when(band == 0, "Remote code execution").otherwise("Synthetic vulnerability test record").alias("description"),
        F.concat(F.lit("CVE-2099-"), padded(i % 9000 + 1000, 4)).alias("cve"), word.alias("severity"), by(9.8, 7.5, 5.0, 2.0).alias("cvss_score"),
        F.when(band == 0, 0.9).when(band == 1, 0.5).otherwise(0.1).alias("epss"), F.concat(F.lit("asset-"), padded(i % 10000, 5)).alias("asset_id"),
        F.concat(F.lit("host-"), padded(i % 10000, 5), F.lit(".example")).alias("hostname"), (band < 2).alias("internet_exposed"),
        F.when(band == 0, "critical").otherwise("medium").alias("business_criticality"), (band < 2).alias("exploit_available"), (band == 0).alias("exploited_in_wild"),
        F.lit("Apply the synthetic vendor update").alias("solution"), F.struct((i / 10000).cast("long").alias("batch")).alias("custom_field"),
    )
    return spark.range(0, count, 1, parts).select(i.alias("index"), record.alias("record"))


def write(spark: SparkSession, count: int, path: str, parts: int = 8) -> None:
    """JSON Lines, one record a line, in `parts` files with the suffix by which a scan knows them."""
    records(spark, count, parts).select(F.to_json("record").alias("value")).write.text(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        if (name := status.getPath().getName()).startswith("part-"):
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".jsonl"))
