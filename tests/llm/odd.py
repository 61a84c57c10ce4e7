"""Rows that every operator must survive: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PHRASE = "the quick brown fox jumps over the lazy dog while seven wizards mix the purple potion in a cellar"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))

TEXTS: list[tuple[int | None, str | None, str | None, str | None]] = [
    (1, None, None, None),
    (2, "", "en", "b"),
    (3, " \t\n ", "en", "a"),
    (4, "one", "de", "a"),
    (5, PHRASE, "en", "a"),
    (6, PHRASE, "en", "a"),
    (7, PHRASE.upper(), None, "b"),
    (8, None, "en", "a"),
    (None, PHRASE, "en", None),
    (None, None, None, None),
    (9, LONG, "fr", "hot"),
    (9, LONG, "fr", "hot"),
    (10, "é ünïcödé 🙂 x y z ﬁ mail jo@ex.org, call +1 (555) 010-9999", "fr", "hot"),
    (11, "a b c d e a b c d e a b c d e f\na b c\na b c\n\nq", "en", "b"),
    (12, "x" * 200_000, "en", "hot"),
    (13, "one", "de", "a"),
    (13, PHRASE + " and more", "de", "a"),
    (14, "\n\n\nx\n", "de", ""),
    (15, " " * 1_000_000, "en", "a"),
    (16, "x" + "\n" * 1_000_000 + " y", "en", "b"),
]

#: Names that operators use inside.
CLASHING = [
    "n_words", "kept", "quality", "size", "weight", "key", "target", "bin", "rest", "root", "node", "band", "bands", "blocks", "mine", "shingles", "found", "spans", "score", "rank", "rejected",
    "held_out", "did", "th", "z", "at", "ranges", "ids", "pieces", "log_weight", "_mix_row", "_mix_copy", "_mix_source", "_pii_found", "_at", "copies", "epochs", "last", "a", "b", "u", "v", "rep", "fp1",
]


def documents(spark: SparkSession, rows=TEXTS) -> DataFrame:
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def crowded(df: DataFrame) -> DataFrame:
    """``df`` with more columns, some null and named as the operators' own."""
    return df.select("*", *[(F.lit(None).cast("string") if i % 2 else F.lit(i)).alias(c) for i, c in enumerate(CLASHING)])


def labels(spark: SparkSession, rows=()) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def sorted_rows(df: DataFrame) -> list[str]:
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    """A-Z alone in lower case."""
    return (text or "").translate({c: c + 32 for c in range(65, 91)})
