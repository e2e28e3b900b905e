"""A corpus pipeline of five stages, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from convfeat.llm import bpe, decontaminate, exact_dedup, jaccard, langid
from convfeat.llm.common import table
from convfeat.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in none of the languages go: without letters, or that no learned language matches."""
    return langid.identified_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.distinct_rows(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, checked by decoding."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.tokenized_rows(docs, path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", languages),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", benchmarks),
    ("byte-level BPE", tokens),
]

#: Language identification and tokens have no SQL; the tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
