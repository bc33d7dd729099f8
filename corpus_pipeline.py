"""The training corpus from the documents, stage by stage.

Each stage reads what the one before has written, and all but the last hand on the columns of ``documents``:
quality rules drop rejected documents, toxicity drops what is predicted toxic, near-duplicate groups keep their smallest
id, personal data is replaced by its kind, and what is left is packed into training sequences.

Each stage bounds the rows that are on their way to Python, for the rest of the session where it is called alone: what it
gives is written by the caller. An executor's memory is that of its JVM, which keeps what it once took, and of its workers.

The pipeline has no SQL: quality and toxicity are learned from the corpus. Tests hold it against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clusterloom.llm import near_dedup, packing, pii, quality, toxicity
from clusterloom.llm.common import few_rows, hand_few_rows, load, shared_folder
from clusterloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_few_rows(spark)
    return quality.accepted(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_few_rows(spark)
    field = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.clean(docs, field, threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_few_rows(spark)
    return near_dedup.without_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_few_rows(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_few_rows(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    with few_rows(spark):
        for name, stage in STAGES:
            path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
