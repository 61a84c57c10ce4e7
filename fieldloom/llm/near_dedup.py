"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of word shingles. Documents of one and the same set
   are collapsed to the smallest id (a fingerprint of 128 bits and the set's size).
2. Signatures of the remaining sets are cut into bands; documents that share a band's bucket
   are candidates, and only those are compared. No pair becomes a row that isn't a link:
   a task compares signatures batch by batch, drops a pair as soon as the posterior probability of
   reaching the threshold falls below ``miss``, and confirms survivors on their full sets.
3. First each bucket's smallest document meets the others. Buckets whose other members the links found so far
   connect are done with. In each that stays open, every two of these others that aren't connected meet, a pair in the
   first bucket that both are in.
4. Components of the links are the classes.

The members of a bucket, or of a smallest document, are dealt out in blocks of at most about ``block`` documents and
``BLOCK_SHINGLES`` shingles, so that a task's memory doesn't grow with a bucket; in an open bucket each two blocks meet.
Joins on ids of many neighbours have stored tables on both sides, so that Spark can split them.

Defined results: a null, empty or blank text has an empty set, is linked with
nothing and is its own component; fewer words than ``k`` make one shingle of all; rows of one id
are one node, and its set is taken from each of the rows; a null id is kept, counted, and
linked with nothing (its component is null). Other columns are not read. ``keep_one`` keeps all rows of
an id that stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import textkernel as tk
from fieldloom.llm.shared import cut, returning, short_batches, small

BATCH = 32  # hashes compared at a time
BLOCK_SHINGLES = 1 << 19
_rng = np.random.default_rng(99)
_FACTORS = _rng.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 2**63, 1024, dtype=np.uint64)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """The upper 32 bits of the minimum of ``size`` hash functions over a set."""
    low = np.full(size, 2**64 - 1, dtype=np.uint64)
    for a in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[a : a + 1024, None] * _FACTORS[:size] + _TERMS[:size]).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


@lru_cache
def least_matches(size: int, threshold: float, miss: float) -> tuple[int, ...]:
    """For each batch end, the fewest matches whose posterior P(similarity >= threshold) is at least ``miss``.

    The prior is uniform; the posterior after m of n matches is Beta(m + 1, n - m + 1).
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, size + 1, BATCH):
        for m in range(n + 1):
            log_density = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid)
            if np.exp(log_density[grid >= threshold]).sum() / len(grid) >= miss:
                out.append(m)
                break
    return tuple(out)


def band_keys(marks: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A bucket for each band of a signature."""
    cut_up = marks.astype(np.uint64).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = tk.mix(key * np.uint64(0x9E3779B97F4A7C15) + cut_up[:, r])
    return key.view(np.int64)


def shingle_rows(documents: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (fingerprint of the set) and bands (array of long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, prints, keys = [], [], []
            for _, data, off in tk.slices(b.column(1)):
                for s in tk.shingle_sets(tk.words(data, off, fold=True), k):
                    counts.append(len(s))
                    prints.append((int(s.sum()), int(tk.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum())) if len(s) else (0, 0))
                    keys.append(band_keys(signature(s, rows * bands), rows, bands) if len(s) else np.empty(0, np.int64))
            two = np.array(prints, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32), np.concatenate(keys) if keys else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), lists], ["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return short_batches(_plain(documents)).mapInArrow(returning(run), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps: each node's neighbours are tied to the smallest of them,
    until every node is tied to its root alone. A step groups and joins on node; no adjacency list is built. The least
    neighbours are stored before they are joined, so that the neighbours of a hub can be split among tasks.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a sorted set with each of the others."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in others])[:-1]])
    return np.add.reduceat((one[at] == flat).astype(np.int64), starts)


def alike(i: int, js: np.ndarray, sets: list[np.ndarray], marks: np.ndarray, percent: int, tests: tuple[int, ...]) -> np.ndarray:
    """Those of ``js`` whose set is similar enough to that of ``i``: sizes, then signatures batch by batch, then the sets themselves."""
    own, sizes = len(sets[i]), np.array([len(sets[j]) for j in js], dtype=np.int64)
    # Of sets whose sizes differ by more than 100 / percent none can be similar enough.
    js = js[100 * np.minimum(sizes, own) >= percent * np.maximum(sizes, own)]
    matches = np.zeros(len(js), dtype=np.int64)
    for t, least in enumerate(tests):
        if not len(js):
            return js
        part = slice(t * BATCH, (t + 1) * BATCH)
        matches += (marks[js, part] == marks[i, part]).sum(1)
        alive = matches >= least
        js, matches = js[alive], matches[alive]
    if not len(js):
        return js
    both, sizes = _overlaps(sets[i], [sets[j] for j in js]), np.array([len(sets[j]) for j in js])
    return js[100 * both >= percent * (own + sizes - both)]


def _links(pdf: pd.DataFrame, percent: int, tests: tuple[int, ...]) -> list[tuple[int, int]]:
    """Links of a cell of a bucket that connect what isn't connected yet: pairs within a block, or across two."""
    marks, bands = (np.stack([np.frombuffer(x, kind) for x in pdf[c]]) for c, kind in (("marks", np.uint32), ("bands", np.int64)))
    here = bands == pdf.band.iloc[0]
    use = np.flatnonzero(here.any(1))  # an id may have sets that aren't in the bucket
    pdf, marks, bands = pdf.iloc[use], marks[use], bands[use]
    if len(pdf) < 2:
        return []
    place, sets = int(here[use[0]].argmax()), [np.frombuffer(x, np.uint64) for x in pdf.shingles]
    ids, sides, label, out = pdf.doc_id.to_numpy(), pdf.mine.to_numpy(), pdf.root.to_numpy().copy(), []
    across = pdf.i.iloc[0] != pdf.j.iloc[0]
    for i in range(len(ids) - 1):
        js = np.arange(i + 1, len(ids))
        js = js[(label[js] != label[i]) & ((sides[js] != sides[i]) if across else True)]
        # Pairs that share an earlier band meet there.
        js = js[~(bands[js, :place] == bands[i, :place]).any(1)]
        for j in alike(i, js, sets, marks, percent, tests):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def _set_rows(documents: DataFrame, ids: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """doc_id, shingles, marks (signature) and bands, as binary, of the texts of ``ids`` (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, off in tk.slices(b.column(1)):
                sets = tk.shingle_sets(tk.words(data, off, fold=True), k)
                some = [i for i, s in enumerate(sets) if len(s)]
                marks = [signature(sets[i], rows * bands) for i in some]
                found = ([sets[i].tobytes() for i in some], [m.tobytes() for m in marks], [band_keys(m, rows, bands).tobytes() for m in marks])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([row + i for i in some], pa.int64())), *[pa.array(x, pa.binary()) for x in found]], ["doc_id", "shingles", "marks", "bands"])

    texts = _plain(documents).join(small(ids), F.col("doc_id") == F.col("node")).select("doc_id", "text")
    return texts.mapInArrow(returning(run), "doc_id long, shingles binary, marks binary, bands binary")


def _blocks(block: int) -> Column:
    """Into how many blocks members are dealt."""
    return F.greatest(F.lit(1), F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")


def _mine(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")


def _star_links(members: DataFrame, sets: DataFrame, percent: int, tests: tuple[int, ...], block: int) -> DataFrame:
    """Links (a, b) of each bucket's smallest document with its others."""
    pairs = cut(members.where("rep <> hub").select("hub", "rep", "n_shingles").distinct())
    dealt = cut(pairs.groupBy("hub").agg(_blocks(block).alias("blocks")))
    others = pairs.join(dealt, "hub").select("hub", _mine(F.col("rep")).alias("part"), F.col("rep").alias("doc_id"), F.lit(False).alias("first"))
    hubs = dealt.select("hub", F.explode(F.expr("sequence(0, blocks - 1)")).alias("part"), F.col("hub").alias("doc_id"), F.lit(True).alias("first"))

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        shingles, marks = [np.frombuffer(x, np.uint64) for x in pdf.shingles], np.stack([np.frombuffer(x, np.uint32) for x in pdf.marks])
        first, ids = pdf["first"].to_numpy(), pdf.doc_id.to_numpy()
        found = {int(ids[j]) for i in np.flatnonzero(first) for j in alike(i, np.flatnonzero(~first), shingles, marks, percent, tests)}
        return pd.DataFrame([(int(pdf.hub.iloc[0]), j) for j in found], columns=["a", "b"], dtype="int64")

    met = others.unionByName(hubs).join(sets.drop("bands"), "doc_id").select("hub", "part", "doc_id", "first", "shingles", "marks")
    return met.groupBy("hub", "part").applyInPandas(confirm, "a long, b long")


def _bucket_links(members: DataFrame, known: DataFrame, sets: DataFrame, percent: int, tests: tuple[int, ...], block: int) -> DataFrame:
    """Links (a, b) that connect members of a bucket which ``known`` (node, root) leaves unconnected."""
    # Its smallest document has met all others of a bucket, so that what is left are pairs of those others.
    rooted = members.where("rep <> hub").join(known, F.col("rep") == F.col("node"), "left").select("band", "rep", "n_shingles", F.coalesce("root", "rep").alias("root"))
    rooted = cut(rooted)
    still = cut(rooted.groupBy("band").agg(F.min("root").alias("one"), F.max("root").alias("other"), _blocks(block).alias("blocks")).where("one < other").select("band", "blocks"))
    dealt = rooted.join(still, "band").withColumn("mine", _mine(F.col("rep"))).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    # Block i meets each block j: once for each unordered pair, and itself.
    dealt = dealt.select("band", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), F.col("rep").alias("doc_id"), "mine", "root")

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_links(pdf, percent, tests) if pdf.root.nunique() > 1 else [], columns=["a", "b"], dtype="int64")

    return dealt.join(sets, "doc_id").groupBy("band", "i", "j").applyInPandas(confirm, "a long, b long")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 75, rows: int = 4, bands: int = 32, miss: float = 1e-7, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    tests = least_matches(rows * bands, percent / 100, miss)
    base = cut(shingle_rows(documents, k, rows, bands))
    sets = base.where("doc_id is not null and n_shingles > 0")
    alone = cut(sets.groupBy("fp1", "fp2", "n_shingles").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep")))
    keys = alone.select("rep", "n_shingles", F.explode("bands").alias("band"))
    hubs = cut(keys.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("band", "hub"))
    members = cut(keys.join(hubs, "band"))
    rows_of = cut(_set_rows(documents, cut(members.select(F.col("rep").alias("node")).distinct()), k, rows, bands))
    first = cut(_star_links(members, rows_of, percent, tests, block))
    more = cut(_bucket_links(members, components(first), rows_of, percent, tests, block))
    # The same set under several ids, and one id with several sets, are links as well.
    same = sets.join(alone.select("fp1", "fp2", "n_shingles", "rep"), ["fp1", "fp2", "n_shingles"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    classes = components(first.unionByName(more).unionByName(same))
    joined = base.select("doc_id", "n_shingles").join(classes, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("root", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` without those whose id is not their component's smallest."""
    gone = cut(near_duplicates(documents, **options).where("not kept").select("doc_id").distinct())
    return documents.join(small(gone), "doc_id", "left_anti").select(documents.columns)

