"""Toxicity scores from a subword model fitted on labelled rows.

Rows whose crc32(doc_id as text) modulo `folds` is `fold` are held out of training. The model is fitted on a bounded
sample: of label k, the per_label[k] training rows whose hashed doc_id is smallest. Scoring is one narrow pass over
all documents; the model that travels with it has a fixed size.

Null or empty text: scored from the bias alone. Null doc_id: scored, not held out. Labels that are null or other than
0 and 1 are not learned from; a doc_id with several labels is learned as each of them. No labelled rows: all scores are
0.5. Repeated rows: scored alike. Empty table: empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, small_batches
from .subword import Model, trained


def remainder(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, per_label: tuple[int, ...], keep: Column | None = None, longest: int = 1 << 16) -> DataFrame:
    """label, text of at most per_label[k] rows of class k, by hashed doc_id, in one order; texts over `longest` bytes are left out."""
    marked = labels.select("doc_id", label.cast("int").alias("label")).filter(F.col("label").between(0, len(per_label) - 1))
    if keep is not None:
        marked = marked.filter(keep)
    some = [marked.filter(F.col("label") == k).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k, most in enumerate(per_label)]
    # at most sum(per_label) ids, so this side is small whatever the input
    ids = reduce(DataFrame.union, some).select(F.col("doc_id").alias("__id"), "label")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    return rows.orderBy("label", F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sum(per_label)).select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, per_label: tuple[int, int] = (2500, 1000), **options) -> Model:
    """Trained in one task, on a sample of bounded rows and bytes (see `subword.trained`)."""
    sample = labelled_sample(docs, labels, F.col("toxic"), per_label, remainder(F.col("doc_id"), folds) != fold)
    return trained(sample, 2, both=True, **options)


def score(docs: DataFrame, model: Model, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p, _ = m.predict(b.column("text"))
            yield batch(doc_id=b.column("doc_id"), held_out=b.column("held_out"), score=p[:, 1], predicted=(p[:, 1] >= 0.5).astype(np.int32))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id"), folds) == fold).alias("held_out"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
