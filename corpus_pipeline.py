"""Corpus pipeline: documents become training sequences in five stages, each written and read again.

Every stage but the last returns the columns of documents. Null texts count as empty; rows with a null doc_id go
through like any other, except that a near-duplicate group keeps such a row only if it has no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spotlake.llm import exact_dedup, near_copies, quality_rules, secret_scan
from spotlake.llm.queries import packed, table
from spotlake.llm.tables import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a learned rule go."""
    return quality_rules.drop_low_quality(docs, quality_rules.learn_rules(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies (SimHash candidates that share 0.8 of their five-word shingles), the smallest doc_id stays."""
    return near_copies.drop_near_copies(docs, words=5, share=0.8)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence of its own."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # learned rules, SimHash components and the tokenizer have no SQL form; tests use a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
