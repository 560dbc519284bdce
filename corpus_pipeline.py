"""Documents to packed training sequences: the stages, each on what the one before kept.

Language ID drops documents without a language, near duplicates leave one document of
each group, passages that an earlier document has are cut out, documents that contain
a benchmark item go, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from linewright.llm import (
    contain_minhash,
    ecoc_language,
    harmonic_pack,
    rlz_dedup,
    simhash,
)
from linewright.llm.common import relieve_executors, staged, table


def relieved(stage: Callable) -> Callable:
    """A stage that begins without the heap that the stages before it left grown."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        relieve_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


@relieved
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ecoc_language.keep_identified(docs)


@relieved
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


@relieved
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rlz_dedup.remove_copies(docs)


@relieved
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contain_minhash.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@relieved
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The executors still have some memory of the stages before.
    return harmonic_pack.pack(docs, encoder_words=200_000, encoder_bytes=2 << 20)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminate", decontaminate),
    ("packing", packing),
]
# Tokenizing, classifiers and bit-majority fingerprints are beyond SQL; the tests run
# the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
