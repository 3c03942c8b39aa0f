"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, encoding.

Each stage is a function of (spark, docs, sf_dir) over all rows that its predecessor kept; all but the last
return the columns of documents. ``run`` applies them to documents, each stage's rows written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echofold.functions.storage import written
from echofold.llm import decontam, minhash, pieces, pii, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic, by a machine fitted on the labelled rows of ``documents``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return minhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with passages of the benchmark."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their encoding: n_tokens, ids (int32 as binary), ids_hash and round_trip.

    Texts stay as they are; round_trip says whether the ids decode to the text.
    """
    return pieces.with_encoding(docs)


STAGES = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal data", private),
    ("sentencepiece", encoded),
]

#: Fitted models and exact tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
