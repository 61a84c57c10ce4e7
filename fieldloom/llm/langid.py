"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte trigrams (letters in lower case,
all else a space), scaled to length 1. Each language has several centroids, found by
spherical k-means on a bounded sample of its labelled rows, an exact number of them whatever ids are null or repeated. A text takes the
language of the centroid of the highest cosine; it is flagged ``rejected`` if
its distance exceeds what nearly all of that language's training rows show.

Defined results: texts that are null or hold no letter are ``und`` with score 0 and
not rejected; with no training rows every text is ``und``; rows with null ids or
repeated rows are predicted each for itself; only id, text and (in training) lang are
read, whatever other columns there are; equal cosines go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import textkernel as tk
from fieldloom.llm.shared import returning

BITS = 12
SIZE = 1 << BITS
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_GROUP = 64  # documents counted at once, so that their counters stay in cache


def trigram_counts(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, counts of its and the next documents' trigrams), one row a document."""
    folded = _FOLD[data]
    # Capital accented letters U+00C0-U+00DE to small ones.
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    high = folded[after]
    folded[after] = np.where((high >= 0x80) & (high <= 0x9E) & (high != 0x97), high + 32, high)
    n = len(off) - 1
    x = folded.astype(np.uint32)
    codes = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS) if len(x) > 2 else np.empty(0, np.uint32)
    blank = (x[:-2] == 32) & (x[1:-1] == 32) if len(x) > 2 else np.empty(0, bool)
    for a in range(0, n, _GROUP):
        b = min(n, a + _GROUP)
        lo, hi = off[a], max(off[a], min(off[b], len(codes)))
        at = np.arange(lo, hi)
        owner = np.searchsorted(off, at, side="right") - 1
        use = (at + 2 < off[owner + 1]) & ~blank[lo:hi]
        flat = (owner[use] - a) * SIZE + codes[lo:hi][use]
        yield a, np.bincount(flat, minlength=(b - a) * SIZE).reshape(b - a, SIZE)


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = total[off[1:]] > total[off[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in data[off[d] : off[d + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # (centroids, SIZE), length 1
    limits: np.ndarray  # largest accepted distance, by centroid

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(texts)
        lang, score, rejected = ["und"] * n, np.zeros(n), np.zeros(n, dtype=bool)
        if not self.languages:
            return lang, score, rejected
        for row, data, off in tk.slices(texts):
            letters = has_letter(data, off)
            for a, counts in trigram_counts(data, off):
                cosine = _unit(np.log1p(counts).astype(np.float32) * self.idf) @ self.centroids.T
                best = cosine.argmax(1)
                for i in np.flatnonzero(letters[a : a + len(best)]):
                    c = best[i]
                    lang[row + a + i], score[row + a + i] = self.languages[c], min(1.0, max(0.0, float(cosine[i, c])))
                    rejected[row + a + i] = 1 - cosine[i, c] > self.limits[c]
        return lang, score, rejected


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    chosen = [0]
    while len(chosen) < min(k, len(x)):  # farthest first
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    centre = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        for c in range(len(centre)):
            if (own == c).any():
                centre[c] = x[own == c].sum(0)
        centre = _unit(centre)
    return centre, (x @ centre.T).argmax(1)


def _least_hashes(rows: DataFrame, quota: int, counts: dict[str, int]) -> dict[str, int]:
    """For each language the ``quota``-th of the distinct ``_h`` of its rows in order, or its last.

    Only a share of each language's hashes is looked at, which grows where repeated rows leave fewer than ``quota`` different ones.
    """
    share = {k: min(1.0, 4 * quota / n) for k, n in counts.items()}
    limits: dict[str, int] = {}
    while share:
        below = F.create_map(*[F.lit(x) for k, part in share.items() for x in (k, min(2**63 - 1, int(part * 2**63)))])
        seen = rows.where(F.col("_h") <= below[F.col("lang")]).select("lang", "_h").distinct()
        first = seen.withColumn("_nth", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_nth") <= quota)
        found = {r[0]: (r[1], r[2]) for r in first.groupBy("lang").agg(F.max("_nth"), F.max("_h")).collect()}  # a row for each language
        limits |= {k: h for k, (_, h) in found.items()}
        share = {k: min(1.0, part * 64) for k, part in share.items() if part < 1 and found.get(k, (0, 0))[0] < quota}
    return limits


def fit_language_model(documents: DataFrame, per_language: int = 800, clusters: int = 3, accept: float = 0.999, most_rows: int = 20_000, most_languages: int = 1000) -> LanguageModel:
    """Fit on ``per_language`` rows of each language, or as many as it has, and on ``most_rows`` in all.

    The rows are those of the least hashes of id and text, each once, whatever ids are null or repeated. Of more than ``most_languages``
    languages the most frequent ones are learned, so that a column full of errors can't grow the model. The driver gets the trigram counts
    of those rows alone, sparse, and works on one language at a time.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")), 1)
    rows = documents.where("lang is not null and text is not null").select("lang", "text", h.alias("_h"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not counts:
        return LanguageModel(np.ones(SIZE, np.float32), [], np.empty((0, SIZE), np.float32), np.empty(0))
    limits = _least_hashes(rows, max(1, min(per_language, most_rows // len(counts))), counts)
    below = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)])
    picked = rows.where(F.col("_h") <= below[F.col("lang")]).groupBy("lang", "_h").agg(F.first("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, grams, tf = [], [], []
            for row, data, off in tk.slices(b.column(1)):
                letters = has_letter(data, off)
                for a, block in trigram_counts(data, off):
                    for i, x in enumerate(block):
                        if letters[a + i] and x.any():
                            some = np.flatnonzero(x)
                            langs.append(b.column(0)[row + a + i].as_py())
                            grams.append(some.astype(np.int16).tobytes())
                            tf.append(np.log1p(x[some]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.binary()), pa.array(tf, pa.binary())], ["lang", "grams", "tf"])

    sample = sorted((r.lang, bytes(r.grams), bytes(r.tf)) for r in picked.mapInArrow(returning(run), "lang string, grams binary, tf binary").collect())
    seen = np.zeros(SIZE, dtype=np.int64)
    for _, grams, _ in sample:
        seen[np.frombuffer(grams, np.int16)] += 1
    idf = np.log((1 + len(sample)) / (1 + seen)).astype(np.float32) + np.float32(1)
    names, centres, limit = [], [], []
    for lang, group in groupby(sample, key=lambda x: x[0]):
        own = list(group)
        x = np.zeros((len(own), SIZE), dtype=np.float32)
        for i, (_, grams, tf) in enumerate(own):
            x[i, np.frombuffer(grams, np.int16)] = np.frombuffer(tf, np.float32)
        x = _unit(x * idf)
        centre, member = _spherical_kmeans(x, clusters)
        for c in range(len(centre)):
            distance = 1 - x[member == c] @ centre[c]
            names.append(lang)
            limit.append(float(np.quantile(distance, accept)) * 1.05 if len(distance) else 1.0)
        centres.append(centre)
    return LanguageModel(idf, names, np.concatenate(centres) if centres else np.empty((0, SIZE), np.float32), np.array(limit))


def identify(documents: DataFrame, model: LanguageModel, *keep: Column) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred, score and rejected of every whole text."""
    rows = documents.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *keep)
    names = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = model.predict(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes[1:])
    return rows.mapInArrow(returning(run), f"{kinds}, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
