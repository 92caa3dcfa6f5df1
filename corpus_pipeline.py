"""The corpus pipeline: documents pass quality rules, a toxicity filter, near-deduplication and mixing, and are encoded.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again.

Defined cases, for every stage: documents of equal id and text are judged alike, and near-deduplication keeps the rows of one id together; rows without an id are judged by their
texts; null and empty texts fail the base rules, so no later stage meets them unless it is called by itself, where they are empty texts; very long texts are read whole; an empty table goes
through all stages and gives no rows; columns besides those of documents stay as they are up to the last stage, which returns the four it names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import bpe, mixing, quality, simhash, toxicity
from strataloom.llm.common import remove, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above the limits of their host go, and so do documents that fail the base rules or are depleted."""
    return quality.kept_documents(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model is trained on what the stage before kept."""
    return toxicity.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays: texts whose five-word shingles overlap by 0.8 or more."""
    return simhash.first_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as drawn for their source, in random order."""
    return mixing.poisson_mix(docs, numbered=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return bpe.encoded_digests(docs, carry=("doc_id", "lang", "source", "n_chars"))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", encode)]

#: SQL can't express the stages that learn or hash shingles; tests/llm compares every stage of run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
