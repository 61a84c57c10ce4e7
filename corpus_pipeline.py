"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), ``docs`` being all that the stage before it kept,
and returns rows with the columns of documents; the last returns token ids.

1. quality rules: documents that the rules or the isolation forest reject go.
2. near-dedup: of each group of near copies the smallest id stays.
3. personal data: every span is replaced by its kind.
4. mixing: each source's documents as often as its target takes them.
5. SentencePiece: ids of each text, held against the library's own and decoded back.

Nulls, empty texts and repeated rows follow each operator's docstring.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import mixing, near_dedup, pieces, pii, quality_rules
from fieldloom.llm.queries import TOKENIZERS
from fieldloom.llm.shared import remove, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-dedup", dedup),
    ("personal data", personal_data),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The isolation forest and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from the shared checkpoint folder. What a stage kept is written there for the next one, and removed after it."""
    docs, place = table(spark, sf_dir, "documents"), os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            remove(spark, f"{place}/{k - 1}")
    return docs
