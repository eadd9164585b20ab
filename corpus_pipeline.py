"""The corpus pipeline: quality, toxicity, near duplicates, personal data, packing.

Every stage takes the documents that the one before kept and returns documents
with the same columns; the last returns the packed pieces.  The classifiers are
fitted on the labelled rows among the stage's own documents.

Edge cases: null texts go through as empty ones; rows with a null doc_id are never
held to labels and go through, as one class if their texts are near copies; of
repeated doc_ids those of different texts stay, of near copies any one; further
columns, whatever their names, are carried to the last stage; an empty table gives
no rows; without labels nothing is dropped for quality, and the lexicons alone
decide on toxicity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import op04_toxicity, op07_ngram_join, op08_quality, op09_pii, op10_packing
from webloom.llm.shared import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return op08_quality.keep_quality(docs, op08_quality.train(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't call toxic."""
    classifier, _, _ = op04_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return op04_toxicity.drop_toxic(docs, classifier)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return op07_ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return op09_pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return op10_packing.pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: Trained models, signatures and tokenizers can't be written in SQL; tests hold the operators of each stage against plain computations, and the stages by their effects.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
