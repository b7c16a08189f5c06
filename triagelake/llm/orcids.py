"""Token ids in ORC: one row per document, in ascending doc_id order.

Files hold doc_id, part, start (ids of the same part before it), n_tokens and ids, as ORC integers in run-length
encoding (version 2), with a row index every `row_stride` rows and Bloom filters on doc_id. The parts are ranges of
doc_id, so each file, stripe and row group covers a narrow range: a filter on doc_id skips by footers, stripe
statistics, row indexes and Bloom filters, and a scan reads stripes in parallel. Only texts are shuffled, not ids.

Null text: the end id alone. Null doc_id: first. Rows that share a doc_id lie side by side, ordered by a hash of the
text. Empty table: empty files. Very long texts: one row each. Further columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, partitions, row_key, small_batches
from .tokens import Encoder, with_end

SCHEMA = "doc_id long, part int, start long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 64 << 20, row_stride: int = 1000, fpp: float = 0.01) -> None:
    """Encode every text, append end_id and write the files."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = Encoder.get(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, counts = with_end(*encoder.encode(b.column("text")), end_id)
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
            yield batch(doc_id=b.column("doc_id"), part=np.full(len(counts), part, np.int32), start=start + ends - counts, n_tokens=counts, ids=lists)
            start += int(ends[-1]) if len(ends) else 0

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("rk"))
    ranged = narrow.repartitionByRange(partitions(spark), "doc_id", "rk").sortWithinPartitions("doc_id", "rk")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(fpp), "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(row_stride), "compression": "zstd"}
    ranged.select("doc_id", "text").mapInArrow(run, SCHEMA).write.options(**options).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; doc_ids prunes files, stripes and row groups."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """part, before: the ids in all parts before it; one row per part."""
    from pyspark.sql import Window

    size = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return size.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the crc32 of the ids, all from the files."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            o, v = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            raw = np.ascontiguousarray(v).view(np.uint8)
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            yield batch(doc_id=b.column("doc_id"), part=b.column("part"), start=b.column("start"), n_tokens=np.diff(o).astype(np.int64), ids_crc32=pa.array(crc, pa.int64()))

    rows = read(spark, path).mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    # one row per file: bounded by the number of shuffle partitions
    rows = rows.join(F.broadcast(positions(spark, path)), "part")
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
