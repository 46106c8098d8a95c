"""Cleans the documents table for training, stage by stage.

Every stage takes what its predecessor kept, written and read again. The last one returns token ids in place of texts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.durable import materialize
from ledgerlens.llm import bpe, decontamination, language_id, ngram_join, secret_scan

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: What near copies share: so many percent of their shingles of so many words. The op8 query has values of its own.
NEAR_COPY_WORDS, NEAR_COPY_PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.identified(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs, NEAR_COPY_WORDS, NEAR_COPY_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.without_secrets(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("byte_bpe", token_ids),
]
#: No SQL expresses a trained network; tests hold the result against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
