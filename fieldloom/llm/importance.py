"""Quality classifier: importance resampling towards target text.

Two generative models over hashed word unigrams and bigrams, one of the target
text and one of all the raw text, give each document a log importance weight,
the log ratio of its likelihoods. Gumbel noise drawn from the document's id
(from the text, where there is none) turns the k largest scores into a sample without replacement in proportion to
the weights. Both models' counts cover every n-gram of their documents.

Defined results: a null or empty text, or one of white space, has no n-grams: its
weight is null and it is never sampled. Repeated rows are scored alike and ties go to the smaller id. Without target rows
the weights are all 0. Columns beside id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import textkernel as tk
from fieldloom.llm.shared import bounded_sample, cut, returning, shuffle_tasks, unit_hash


def _buckets(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram, document by document, and each document's first one."""
    w = tk.words(data, off, fold=True)
    pairs, at = tk.windows(w, 2)
    document = np.repeat(np.arange(len(w.counts)), w.counts)
    owner = np.concatenate([document, document[at]])
    order = np.argsort(owner, kind="stable")
    hashed = np.concatenate([tk.mix(w.hashes), pairs])[order] >> np.uint64(64 - bits)
    return hashed.astype(np.int64), np.searchsorted(owner[order], np.arange(len(w.counts) + 1))


def ngram_counts(documents: DataFrame, bits: int) -> DataFrame:
    """bucket, raw and target counts; ``documents`` has text and a boolean target.

    Each task adds its own rows up, so a shuffle row is a bucket of a task, not an n-gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for b in batches:
            chosen = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, data, off in tk.slices(b.column(0)):
                buckets, first = _buckets(data, off, bits)
                raw += np.bincount(buckets, minlength=1 << bits)
                inside = np.repeat(chosen[row : row + len(off) - 1], np.diff(first))
                target += np.bincount(buckets[inside], minlength=1 << bits)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return documents.select("text", "target").mapInArrow(returning(run), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit_ratio(documents: DataFrame, target_ids: DataFrame, bits: int = 15, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket. ``target_ids`` is of a bounded size: it is broadcast."""
    marked = documents.select("doc_id", "text").join(F.broadcast(target_ids.select("doc_id").distinct().withColumn("target", F.lit(True))), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = ngram_counts(marked, bits).toPandas()  # 2 ** bits rows at most
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
    if not target.sum():
        return np.zeros(1 << bits)
    smooth = lambda x: np.log(x + smoothing) - np.log(x.sum() + smoothing * len(x))
    return smooth(target) - smooth(raw)


def log_weights(documents: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_grams and log_weight (null without n-grams)."""
    bits = int(len(ratio)).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sums = [np.empty(0, np.int64)], [np.empty(0)]
            for _, data, off in tk.slices(b.column(1)):
                buckets, first = _buckets(data, off, bits)
                n = np.diff(first)
                total = np.zeros(len(n))
                if len(buckets):
                    total[n > 0] = np.add.reduceat(ratio[buckets], first[:-1][n > 0])
                counts.append(n)
                sums.append(total)
            n, total = np.concatenate(counts), np.concatenate(sums)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total, mask=n == 0), b.column(2)], ["doc_id", "n_grams", "log_weight", "name"])

    text = F.col("text").cast("string")
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(text))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), name.alias("name"))
    return rows.mapInArrow(returning(run), "doc_id long, n_grams long, log_weight double, name string")


def global_rank(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank`` (from 1) in the given order, by range partitions and their sizes; no single-task sort."""
    laid = cut(df.repartitionByRange(shuffle_tasks(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in laid.groupBy(part.alias("p")).count().collect()}  # a row for each partition
    starts, before = {}, 0
    for p in sorted(sizes):
        starts[p], before = before, before + sizes[p]
    if not starts:
        return laid.withColumn("rank", F.lit(0).cast("long")).drop("_at")
    offset = F.create_map(*[F.lit(x) for p in sorted(starts) for x in (int(p), int(starts[p]))])
    return laid.withColumn("rank", offset[part.cast("int")] + within + 1).drop("_at")


def resample(documents: DataFrame, target_ids: DataFrame, share: float, bits: int = 15, seed: int = 11) -> DataFrame:
    """doc_id, n_grams, log_weight, score, rank and kept: the Gumbel top-k, k being ``share`` of the documents with n-grams."""
    noise = -F.log(-F.log(unit_hash(F.col("name"), F.lit(seed))))
    # Stored, as the order by ranges reads it twice: for its bounds, then for its rows.
    weighed = cut(log_weights(documents, fit_ratio(documents, target_ids, bits)).withColumn("score", F.col("log_weight") + noise).drop("name"))
    ranked = global_rank(weighed, F.col("score").desc_nulls_last(), F.col("doc_id").asc_nulls_last())
    k = int(round(share * ranked.where("score is not null").count()))
    return ranked.withColumn("kept", F.col("score").isNotNull() & (F.col("rank") <= k))


def target_of(labels: DataFrame, most: int = 20_000) -> tuple[DataFrame, float]:
    """Ids of at most ``most`` labelled good and not toxic rows, and the share of good rows among the labelled."""
    per = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    share = per.agg(F.avg("quality")).first()[0]
    return bounded_sample(per.where("quality = 1 and toxic = 0").select("doc_id"), "doc_id", most), 1.0 if share is None else float(share)
