"""From raw documents to packed batches: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotelens.llm.exact import drop_exact_copies
from quotelens.llm.language import accepted_documents
from quotelens.llm.mixing import mixed_documents
from quotelens.llm.packing import pack
from quotelens.llm.simhash import drop_near_copies
from quotelens.plans.checkpoints import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return accepted_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weight; a document that is taken twice is there twice."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup),
    ("mixing", mixing), ("packing", packing),
]

# Kernel regression and XXH64 fingerprints are not SQL; a brute-force version is in the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
