"""Findings as they arrive: the narrow stages run on a stream unchanged, and each batch is compared with those before."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators import pipeline
from triagelake.sources import scan


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Raw records of the files that come into a folder. ordinal orders records within a file only."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(folder)
    names = [c.split()[0] for c in re.sub("<[^>]*>", "", scan.RAW).split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                if path.lower().endswith(scan.SUFFIXES):
                    yield pd.DataFrame(list(scan.parse(path, bytes(content), zlib.crc32(path.encode()) >> 1)), columns=names)

    return files.select("path", "content").mapInPandas(run, scan.RAW)


def tiers(raw: DataFrame) -> DataFrame:
    """Normalised, assessed and tiered findings; no state is kept."""
    return pipeline.tiers(pipeline.assess(pipeline.accepted(pipeline.normalise(raw))))


def counts(findings: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Findings by tier and window of their last sighting; later ones than the watermark are left out."""
    t = findings.withColumn("seen", F.try_to_timestamp("last_seen")).withWatermark("seen", late)
    return t.groupBy(F.window("seen", window), "tier").agg(F.count("*").alias("findings"))


def store_batches(findings: DataFrame, registry: str, checkpoint: str):
    """Append each batch with new = no earlier batch held its vulnerability and target. Returns the started query.

    A batch that is run again is written to its own folder again, so nothing is counted twice.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        entity = batch.withColumn("entity", F.sha2(F.concat_ws("|", "vulnerability", F.array_join(pipeline.asset_tokens(), ",")), 256))
        path = spark._jvm.org.apache.hadoop.fs.Path(registry)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        known = spark.read.parquet(registry).filter(F.col("batch") < n).select("entity").distinct().withColumn("old", F.lit(True)) if fs.exists(path) else None
        out = entity.withColumn("old", F.lit(None).cast("boolean")) if known is None else entity.join(known, "entity", "left")
        cols = [c for c in out.columns if c not in ("exact", "leaf", "old")]
        out.select(*cols, F.col("old").isNull().alias("new")).write.mode("overwrite").parquet(f"{registry}/batch={n}")

    return findings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
