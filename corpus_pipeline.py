"""Corpus pipeline: each stage reads what the one before it kept, written as Parquet.

Stages: toxic documents go, one document of each near-duplicate group stays, contaminated documents go, personal data is
masked, and the rest is mixed to target weights. All but the last return the columns of documents; the last returns
a row for each use of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import op2_mixing, op5_simhash, op6_toxicity, op7_decontaminate, op9_pii
from quillspark.llm.common import scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text scores below the threshold; the model learns from the labels of these documents. Null and empty
    texts stay, repeated rows and ids are each judged by their own text, and without labels of both kinds all rows stay."""
    return op6_toxicity.drop_toxic(docs, op6_toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of each group of texts linked at an exact Jaccard similarity of 0.8 or more over five-word shingles: that of the
    least id, null ids last. Null and empty texts are one group; an id whose texts lie in several groups can stay for each; of
    rows equal in id and text one stays."""
    return op5_simhash.keep_one(docs, words=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark hit, or with hits in less than a twentieth of their words. Null and empty texts have no words and
    stay; an empty benchmark leaves all rows."""
    return op7_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with spans of personal data replaced by [KIND] and n_chars set anew where text changed; null texts stay null."""
    return op9_pii.mask(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document: every row is used at least once. A null source is a source; sources without tokens keep
    their rows; rows with one id are told apart by order alone."""
    return op2_mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: The toxicity model and the shingle hashes can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
