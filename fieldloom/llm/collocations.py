"""Phrases whose words come together more often than their parts would let expect, for each language.

Texts are tokenised once, into chunks of one language: the chunk's own words and the sequence of their numbers, 0 where a piece
ends. Pass k over the chunks counts phrases of k words exactly, and in the same pass adds those of k + 1 words up in
2^``bits`` hash buckets, each up to ``least`` (a sum of counts cut off at ``least`` reaches it whenever the counts do). Buckets that reach ``least``
are one bitmap; the phrases found frequent make another one of the same size. Both are broadcast, 2^``bits`` bits each however much text there is: the
next pass counts a phrase only if each part of one word less is in the frequent ones' bitmap (Apriori) and the phrase itself in the buckets'. A bitmap
lets some phrases through for nothing but never keeps one out, and the counts decide, so that results don't depend on ``bits``.

Counts are added up in the tasks before they are shuffled; bucket counters travel as blocks of bytes and are added up as they
stream in. Scores are in decimals of 38 digits.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each; words and texts of
any length are whole; of equal scores the more frequent phrase comes first, then the first in byte order; a language without phrases gives no
rows, nor does an empty table; ids and other columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import cut, remove, returning, shared_folder, shuffle_tasks
from fieldloom.llm.textkernel import mix

ENDS = b".,;:!?\n\x0b\x0c\r"
TOKEN = rb"[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+"
#: Bytes of text in a chunk, or one text.
CHUNK = 1 << 23
#: Buckets in a block of counters.
BLOCK = 1 << 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
PARTS = 64


def _chunks(documents: DataFrame) -> DataFrame:
    """(lang, n_words, words, ids): words joined by line ends, numbered from 1 in ``ids`` (int32), with a 0 at each end of a piece."""
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TOKEN).findall

        def chunk(lang: str, texts: list[bytes]) -> pa.RecordBatch:
            number: dict[bytes, int] = defaultdict(count(1).__next__)
            number.update((bytes([e]), 0) for e in ENDS)
            parts = []
            for text in texts:
                # In bytes lower() changes A-Z alone.
                parts += [np.fromiter(map(number.__getitem__, found := find(text.lower())), dtype=np.int32, count=len(found)), np.zeros(1, np.int32)]
            ids = np.concatenate(parts)
            values = [[lang], [int(np.count_nonzero(ids))], [b"\n".join(list(number)[len(ENDS) :])], [ids.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, [pa.string(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["lang", "n_words", "words", "ids"])

        for b in batches:
            held: dict[str, tuple[list[bytes], int]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not text.is_valid:
                    continue
                texts, size = held.pop(lang, ([], 0))
                texts.append(text.as_buffer().to_pybytes())
                size += len(texts[-1])
                if size >= CHUNK:
                    yield chunk(lang, texts)
                else:
                    held[lang] = texts, size
            for lang, (texts, _) in held.items():
                yield chunk(lang, texts)

    return rows.mapInArrow(returning(run), "lang string, n_words long, words binary, ids binary")


def _inside(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """A hash for each word in its language; that of no word, 0, first."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([0, *[xxhash.xxh3_64_intdigest(w, seed) for w in words]], dtype=np.uint64)


def _longer(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with a word more."""
    return mix(hashes * _ODD + word)


def _pass(chunks: DataFrame, k: int, bitmaps: Broadcast | None, bits: int, least: int, last: bool) -> DataFrame:
    """Pass ``k``: rows (lang, phrase, n) of phrases of k words that may be frequent, and rows (block, counters) of those of one word more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, buckets = bitmaps.value if bitmaps else ([], None)
        counters = np.zeros(0 if last else 1 << bits, dtype=np.uint8)

        def rows(lang: list, phrase: list, n: list, block: list, data: list) -> pa.RecordBatch:
            size = max(len(phrase), len(block))
            values = [lang or [None] * size, phrase or [None] * size, n or [None] * size, block or [None] * size, data or [None] * size]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["lang", "phrase", "n", "block", "data"])

        for b in batches:
            for lang, blob, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words = blob.split(b"\n")
                x = np.frombuffer(ids, dtype=np.int32)
                own = _word_hashes(lang, words)
                may = own.astype(bool) if k == 1 else _inside(frequent[0], own, bits)
                may[0] = False
                single, h = own[x], own[x]
                ok = may[x]  # whether a phrase of j words that may be frequent starts here
                at = np.flatnonzero(ok)
                for j in range(2, k + 1):
                    at = np.flatnonzero(ok[:-1] & ok[1:])
                    longer = _longer(h[at], single[at + j - 1])
                    has = _inside(buckets if j == k else frequent[j - 1], longer, bits)
                    at = at[has]
                    h = np.zeros(len(x), dtype=np.uint64)
                    h[at] = longer[has]
                    ok = np.zeros(len(x), dtype=bool)
                    ok[at] = True
                key = x[at].astype(np.int64)
                for j in range(1, k):
                    key = np.unique(key, return_inverse=True)[1] * (len(words) + 1) + x[at + j]
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                places = x[at[first][:, None] + np.arange(k)] - 1
                for a in range(0, len(first), 1 << 16):
                    phrases = [b" ".join([words[i] for i in p]).decode() for p in places[a : a + (1 << 16)].tolist()]
                    yield rows([lang] * len(phrases), phrases, n[a : a + (1 << 16)].tolist(), [], [])
                if not last:
                    at = np.flatnonzero(ok[:-1] & ok[1:])
                    which, more = np.unique((_longer(h[at], single[at + k]) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                    counters[which] = np.minimum(least, counters[which] + np.minimum(more, least))
        yield from (rows([], [], [], part, data) for part, data in _blocks(counters))

    kinds = "lang string, phrase string, n long, block int, data binary"
    return chunks.select("lang", "words", "ids").mapInArrow(returning(run), kinds)


def _blocks(counters: np.ndarray) -> Iterator[tuple[list[int], list[bytes]]]:
    """Blocks of counters that aren't all 0, some at a time."""
    table = counters.reshape(-1, BLOCK)
    some = np.flatnonzero(table.any(1)).tolist()
    for a in range(0, len(some), 256):
        yield some[a : a + 256], [table[i].tobytes() for i in some[a : a + 256]]


def _bitmap(blocks: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit a bucket, packed: whether its counters, from all tasks, reach ``least``. The driver gets 2^bits bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                more = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
                total[block] = np.minimum(least, more + total.get(block, 0)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in total.values()], pa.binary())], ["block", "data"])

    whole = np.zeros((1 << bits) // 8, dtype=np.uint8)
    added = blocks.repartition(shuffle_tasks(blocks.sparkSession), "block").mapInArrow(run, "block int, data binary")
    for r in added.collect():
        whole[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.data, dtype=np.uint8)
    return whole


def _marked(frequent: DataFrame, bits: int, least: int) -> DataFrame:
    """Blocks of counters that are ``least`` where a frequent phrase is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, dtype=np.uint8)
        for b in batches:
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = _word_hashes(lang, phrase.encode().split(b" "))[1:]
                counters[int(reduce(_longer, h[1:, None], h[:1])[0]) >> (64 - bits)] = least
        for part, data in _blocks(counters):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    return frequent.select("lang", "phrase").mapInArrow(returning(run), "block int, data binary")


def frequent_phrases(documents: DataFrame, longest: int = 4, least: int = 30, bits: int = 24) -> tuple[list[DataFrame], DataFrame]:
    """(lang, phrase, n) of the phrases of 1, 2, ... ``longest`` words with at least ``least`` occurrences, and (lang, n) of all words."""
    if not 1 <= least <= 255 or not 12 <= bits <= 32:
        raise ValueError("least must be 1 to 255, a byte, and bits 12 to 32")
    spark: SparkSession = documents.sparkSession
    place = os.path.join(shared_folder(spark), f"phrases-{uuid.uuid4().hex}")
    _chunks(documents).write.option("compression", "zstd").parquet(f"{place}/chunks")
    chunks = spark.read.parquet(f"{place}/chunks")
    totals = cut(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")))
    found: list[DataFrame] = []
    marks: list[np.ndarray] = []
    buckets = None
    for k in range(1, longest + 1):
        sent = spark.sparkContext.broadcast((marks, buckets))
        _pass(chunks, k, sent, bits, least, k == longest).write.option("compression", "zstd").parquet(f"{place}/{k}")
        made = spark.read.parquet(f"{place}/{k}")
        found.append(cut(made.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)))
        if k < longest:
            buckets = _bitmap(made.where("block is not null").select("block", "data"), bits, least)
            marks.append(_bitmap(_marked(found[-1], bits, least), bits, least))
        remove(spark, f"{place}/{k}")
        sent.destroy()
    remove(spark, place)
    return found, totals


def collocations(documents: DataFrame, longest: int = 4, least: int = 30, covered: int = 80, most: int = 2000, bits: int = 24) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``most`` best phrases of 2 to ``longest`` words.

    A phrase's score is floor(2,000,000 a / (l + r)) at its weakest cut, its parts having l and r occurrences and itself a. A phrase goes if a longer one that
    contains it has at least ``covered`` percent of its occurrences.
    """
    counted, totals = frequent_phrases(documents, longest, least, bits)
    phrases = reduce(DataFrame.union, counted[1:]).withColumnRenamed("n", "a").withColumn("words", F.split("phrase", " ", -1))
    parts = reduce(DataFrame.union, counted[:-1])

    def slices(shortest: int, longest_less: int):  # noqa: ANN202
        """Contiguous parts of ``words`` of ``shortest`` words and up to all but ``longest_less``."""
        size = F.size("words")
        lengths = F.when(size - longest_less >= shortest, F.sequence(F.lit(shortest), size - longest_less)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))

    inside = phrases.where(F.size("words") > 2).select("lang", F.explode(slices(2, 1)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    exact = "decimal(38,0)"
    kept = phrases.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast(exact) * F.col("longer") < F.lit(covered).cast(exact) * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    score = F.expr(f"(cast(2000000 as {exact}) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.score")
    # The best of each of some parts of a language first, so that no task orders a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = weakest.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= most)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
