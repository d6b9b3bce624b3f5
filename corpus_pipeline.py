"""A corpus from raw documents to packed batches: STAGES in order, each a function (spark, docs, sf_dir) -> DataFrame.

All stages but the last return the columns of documents. The models are trained on each stage's own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import jaccard_join, langid, packing, pii, quality_rules
from textloom.llm.common import documents, remove, shared_dir, store
from textloom.llm.queries import tokenizer_path


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove boilerplate lines; drop documents that fail the base rules or are depleted."""
    return quality_rules.clean(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in no learned language."""
    return langid.keep_known(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies: shingles of five words, similarity 0.8."""
    return jaccard_join.first_of_each(docs, width=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in length buckets and token-budget batches."""
    return packing.report(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", rules_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: Models that are trained on the corpus have no SQL form; tests check what each stage decides on documents made for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each stage is written as Parquet to shared storage and read again.

    What a stage stored on its way, and the stage before the last one written, are deleted as soon as nothing reads them.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with store() as own:
            path = f"{shared_dir(spark)}/textloom-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
            stage(spark, docs, sf_dir).write.parquet(path)
        own.clear(spark)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
