"""A training corpus from raw documents: rules, near duplicates, personal data, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triagelake.llm import jaccard, mixing, packing, pii, quality
from triagelake.llm.common import scratch
from triagelake.llm.tokens import tokenizer_path

#: What is to be left of the expected tokens of the domains poor, good and toxic (mixing.DOMAINS).
FACTORS = [0.9, 0.98, 0.4]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the text rules nor are depleted, without the lines above the limit.

    Null and empty texts go. Rows that repeat: kept or dropped together.
    """
    return quality.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the least doc_id; of rows that repeat, one.

    Null and empty texts are similar to nothing. Null doc_ids: kept where nothing similar has one.
    """
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data generalised and disclosing terms removed; null and empty texts as they are."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by rates of at most 1 that bring the domains' expected tokens to their targets.

    Targets are factors of what there is, so that they can be met whatever the domains' shares; if they are not, a warning
    says so. Null and empty texts: kept. Rows that repeat: kept or dropped together.
    """
    return mixing.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), FACTORS, most=1.0, relative=True)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; null and empty texts are the end id alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, tokens=2048)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing to target weights", mixture), ("packing", sequences)]
#: The stages learn models and pack token ids, which SQL can't; the tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), scratch(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
