"""A training corpus from ``documents``: five stages, each over all that the one before kept.

1. language: documents whose language cannot be told go.
2. near duplicates: one document of each group stays (five-word shingles, 0.8).
3. benchmark: documents that hold a benchmark item go.
4. secrets: found secrets are masked in the text.
5. pieces: documents become reproducibly sampled SentencePiece tokens, checked by decoding.

Each stage's result is written as Parquet and reread, and dropped once the next stage's is written.
All columns of the input stay up to the fourth stage, whatever their names; the last returns doc_id,
tokens and lossless. SQL cannot express the stages; the tests hold them against brute-force versions.

Defined results, by stage:

- null, empty and letterless texts are rejected by the first stage; the others keep and pass on null
  and empty texts.
- a null doc_id is a row like any other: it is never learned from, never merged with a copy, judged
  against the benchmark, masked and tokenised.
- ties: of a group of near duplicates the least doc_id stays; rows that repeat a doc_id become one in
  the second stage and are judged one by one by the others.
- null lang, source and n_chars change nothing; n_chars follows the text where a secret was masked.
- very long texts are read whole by every stage; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataline.llm import decontaminate, language_id, minhash_dedup, pieces, secrets
from strataline.store import drop, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicated(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.tokenize(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secret_masking),
    ("pieces", tokens),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(before)  # the input table itself stays, since it is in another folder
    return docs
