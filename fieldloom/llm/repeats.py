"""Dedup of repeated strings by grouping suffixes: every byte of a string of ``width`` bytes that starts twice or more is removed.

Not the sort by digits itself: no pass takes successive digits and nothing is ordered by prefix. Only equality of the
first ``width`` bytes counts, so suffixes are grouped by 64-bit hashes, and a suffix that is alone after a pass drops
out. First it enters under its anchor, the k-gram of the least hash within its first ``width`` bytes. Equal strings
have equal anchors at equal offsets, so no repeat is lost, and neighbouring suffixes share theirs; that no unequal
strings are taken for equal rests on the hashes having no collisions.

1. Anchor: suffixes under one anchor are a row. Rows whose anchor occurs once drop out. Texts are read once
   for this; what is stored of each is its rows, as arrays.
2. Extent: all bytes that the suffixes of a row read. Equal extents at equal offsets are repeats as a whole,
   and of these one row goes on, and only if its anchor has other extents.
3. Full depth: the suffixes of the extents that go on are compared by all ``width`` bytes among those
   of one anchor. The rows of an anchor meet in one task, as sorted runs, where there are at most
   ``most_rows``; beyond that each suffix is a row, grouped and joined by its hash.

Strings never cross documents, and are judged on the input. Hashes are of 128 bits, half of them the anchor's.

The same passes find shared passages, of which nothing is removed: a suffix then begins at a word, ``width`` counts words, a word
is a 64-bit hash, and what repeats within one row only doesn't count.

Defined results: null and empty texts have 0 bytes and the digest of nothing; texts shorter than
``width`` keep all; repeated rows (even of one id) remove each other; null ids keep their rows;
runs that touch or overlap count as one; other columns are not read. Texts of any length are read whole, and a
task holds a few megabytes of texts at a time, or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import textkernel as tk
from fieldloom.llm.shared import cut, returning, short_batches, shuffle_tasks

GRAM = 200  # bytes of an anchor; half of the default width
PACKED = 4096  # anchors in an array
SLICE_BYTES = 1 << 18  # of texts whose anchors a task looks for at once, or one text
HELD_BYTES = 4 << 20  # of texts or extents that a task gathers before it gives them out
_NO_ID = -(1 << 63)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, did and th (together the row's key, never null) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return short_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def anchors_of(data: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run of suffixes of one anchor: document, first suffix, suffixes after it, anchor's offset from the first, anchor hash, extent hash."""
    n = len(data)
    if n < width:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),) * 2
    prefix = tk.prefix_hash(data)
    at = np.arange(n - gram + 1)
    hashes = tk.range_hash(prefix, at, at + gram)
    # Least of each run of w grams, the position in the lower bits: minima from the left and from the right of blocks of w.
    w = width - gram + 1
    key = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    blocks = np.concatenate([key, np.full((-len(key)) % w + w, 2**64 - 1, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    total = n - width + 1
    anchor = (np.minimum(right[:total], left[w - 1 : w - 1 + total]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    document = np.repeat(np.arange(len(off) - 1), np.diff(off))[:total]
    inside = np.arange(total) + width <= off[document + 1]
    change = anchor[1:] != anchor[:-1]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= change | ~inside[:-1]
    ends[:-1] &= change | ~inside[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    p = anchor[first]
    shape = ((last - first) << 12 | (p - first)).astype(np.uint64)
    extent = tk.mix(tk.range_hash(prefix, first, last + width) ^ tk.mix(shape + np.uint64(1)))
    return document[first], first - off[document[first]], last - first, p - first, hashes[p], extent


def _anchor_rows(keyed: DataFrame, width: int, gram: int, words: bool) -> DataFrame:
    """did, th, at (first suffix << 24 | suffixes after it << 12 | anchor's offset), anchor and extent hashes; read from a stored table.

    That table has arrays of at most ``PACKED`` rows, so that it holds little but the numbers themselves. For ``words`` it has
    a number of the input row, too, as repeated rows have the same did and th.
    """
    names = ["did", "th", "row"] if words else ["did", "th"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = [b.column(c).to_numpy() for c in names]
            for row, data, off in tk.slices(b.column("text"), SLICE_BYTES):
                if words:
                    found = tk.words(data, off)
                    data, off = found.hashes, found.first
                d, first, more, p, anchor, extent = anchors_of(data, off, width, gram)
                if not len(d):
                    continue
                starts = np.union1d(np.flatnonzero(np.append(True, d[1:] != d[:-1])), np.arange(0, len(d), PACKED))
                bounds = pa.array(np.append(starts, len(d)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (first << 24 | more << 12 | p, anchor.view(np.int64), extent.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*[pa.array(x[row + d[starts]]) for x in key], *lists], [*names, "at", "anchor", "extent"])

    numbered = keyed.withColumn("row", F.monotonically_increasing_id()) if words else keyed
    schema = ", ".join([*[f"{c} long" for c in names], *[f"{c} array<long>" for c in ("at", "anchor", "extent")]])
    packed = numbered.select(*names, "text").mapInArrow(returning(run), schema)
    return cut(packed).select(*names, F.inline(F.arrays_zip("at", "anchor", "extent")))


def _stored(keyed: DataFrame) -> DataFrame:
    """doc_id, did, th and z, the compressed text behind its length: what is shuffled to meet a document's ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for b in batches:
            z = []
            for text in b.column(3):
                raw = memoryview(text.as_buffer() or b"")
                z.append(len(raw).to_bytes(8, "little") + (codec.compress(raw, asbytes=True) if len(raw) else b""))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z, pa.binary())], ["doc_id", "did", "th", "z"])

    return keyed.mapInArrow(returning(run), "doc_id long, did long, th long, z binary")


def _text(z: bytes) -> bytes:
    n = int.from_bytes(z[:8], "little")
    return pa.Codec("zstd").decompress(z[8:], n, asbytes=True) if n else b""


def _extent_rows(stored: DataFrame, wanted: DataFrame, width: int, words: bool) -> DataFrame:
    """The extents that go on, with their bytes. ``wanted`` has did, th and an array of (anchor, lo, hi, at, open, crowded)."""
    names = ["anchor", "lo", "hi", "did", "th", "at", "open", "crowded", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, th, z = (b.column(c) for c in ("did", "th", "z"))
            for i in range(b.num_rows):
                own, raw = b.column("extents")[i].values, memoryview(_text(z[i].as_py()))
                at = own.field("at").to_numpy()
                first, end = at >> 24, (at >> 24) + (at >> 12 & 4095) + width
                if words:
                    split = tk.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    first, end = split.starts[first], split.ends[end - 1]
                step = max(1, HELD_BYTES // (16 * width if words else 2 * width))
                for a in range(0, len(own), step):
                    part = own.slice(a, step)
                    found = pa.array([raw[x:y] for x, y in zip(first[a : a + step].tolist(), end[a : a + step].tolist(), strict=True)], pa.binary())
                    key = [pa.array(np.full(len(part), x.as_py())) for x in (did[i], th[i])]
                    yield pa.RecordBatch.from_arrays([*[part.field(c) for c in names[:3]], *key, *[part.field(c) for c in names[5:8]], found], names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small batches put together."""
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size >= HELD_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)

    schema = "anchor long, lo long, hi long, did long, th long, at long, open boolean, crowded boolean, bytes binary"
    return stored.select("did", "th", "z").join(wanted, ["did", "th"]).mapInArrow(returning(joined), schema)


def _suffixes(blobs: pa.Array, at: np.ndarray, width: int, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix of the extents: row, place in the row, hash of its ``width`` bytes or words and its anchor's offset."""
    off = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    data = np.frombuffer(blobs.buffers()[2], np.uint8)[off[0] : off[-1]]
    if words:
        split = tk.words(data, off - off[0])
        data, off = split.hashes, split.first
    counts = (at >> 12 & 4095) + 1
    row = np.repeat(np.arange(len(at)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (off[:-1] - off[0])[row] + place
    hashes = tk.range_hash(tk.prefix_hash(data), start, start + width)
    return row, place, tk.mix(hashes ^ tk.mix(((at & 4095)[row] - place).astype(np.uint64) + np.uint64(7)))


def _in_runs(extents: DataFrame, width: int, words: bool) -> DataFrame:
    """did, th, first and last of repeated suffixes in open extents; each anchor's extents are a sorted run of one partition.

    A suffix repeats if its extents differ in lo and hi: a repeated input row may have sent an extent twice.
    """

    def marked(t: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, at = t["anchor"].to_numpy(), t["at"].to_numpy()
        row, place, hashes = _suffixes(t["bytes"].combine_chunks(), at, width, words)
        keys = hashes ^ tk.mix(anchor.view(np.uint64))[row]
        order = np.argsort(keys, kind="stable")
        begins = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        least = np.minimum.reduceat(t["lo"].to_numpy()[row][order], begins)
        most = np.maximum.reduceat(t["hi"].to_numpy()[row][order], begins)
        twice = np.empty(len(keys), dtype=bool)
        twice[order] = np.repeat(least != most, np.diff(np.append(begins, len(keys))))
        twice &= t["open"].to_numpy()[row]
        if twice.any():
            joined = np.zeros(len(twice), dtype=bool)
            joined[1:] = twice[1:] & twice[:-1] & (row[1:] == row[:-1])
            begin = np.flatnonzero(twice & ~joined)
            length = np.add.reduceat(twice.astype(np.int64), begin)
            owner = row[begin]
            first = (at >> 24)[owner] + place[begin]
            yield pa.RecordBatch.from_arrays([pa.array(t["did"].to_numpy()[owner]), pa.array(t["th"].to_numpy()[owner]), pa.array(first), pa.array(first + length - 1)], ["did", "th", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < 2048:
                continue
            t = pa.Table.from_batches(held)
            anchor = t["anchor"].to_numpy()
            split = int(np.searchsorted(anchor, anchor[-1]))  # the last run may go on in the next batch
            if split:
                yield from marked(t.slice(0, split))
                held = t.slice(split).combine_chunks().to_batches()
                rows = t.num_rows - split
        if held:
            yield from marked(pa.Table.from_batches(held))

    laid = extents.repartition(shuffle_tasks(extents.sparkSession), "anchor").sortWithinPartitions("anchor")
    return laid.mapInArrow(returning(run), "did long, th long, first long, last long")


def _by_suffix(extents: DataFrame, width: int, words: bool) -> DataFrame:
    """The same for anchors of any number of extents: a row for each suffix, grouped by hash and joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(a, 512) for whole in batches for a in range(0, whole.num_rows, 512)):
            at = b.column("at").to_numpy()
            row, place, hashes = _suffixes(b.column("bytes"), at, width, words)
            columns = [b.column(c).to_numpy(zero_copy_only=False)[row] for c in names[:6]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, (at >> 24)[row] + place, hashes.view(np.int64))], names)

    names = ["anchor", "lo", "hi", "did", "th", "open", "first", "suffix"]
    rows = extents.mapInArrow(returning(run), "anchor long, lo long, hi long, did long, th long, open boolean, first long, suffix long")
    twice = rows.groupBy("anchor", "suffix").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a <> b").select("anchor", "suffix")
    return rows.where("open").join(twice, ["anchor", "suffix"]).select("did", "th", "first", F.col("first").alias("last"))


def repeated_ranges(documents: DataFrame, width: int = 400, gram: int = GRAM, most_rows: int = 8192, words: bool = False) -> DataFrame:
    """did, th and ranges, an array of (first, last) repeated suffixes, of each document that has any.

    With ``words`` all numbers are of words, and suffixes are repeated that another row has as well.
    """
    if not 1 <= gram <= width < gram + 4096:
        raise ValueError("gram must be at most width, and width less than gram + 4096: an extent's lengths have 12 bits each")
    keyed = _keyed(documents)
    rows = _anchor_rows(keyed, width, gram, words)
    many = (F.min("row") != F.max("row") if words else F.count("*") > 1).alias("many")
    repeated = rows.groupBy("anchor").agg(many, F.count("*").alias("total"), F.min("extent").alias("a"), F.max("extent").alias("b")).where("many")
    repeated = cut(repeated.select("anchor", (F.col("a") != F.col("b")).alias("varied"), (F.col("total") > most_rows).alias("crowded")))
    # Stored, or what groups them by anchor and extent would keep the join's partitions, and so all rows of a frequent anchor in one task.
    live = cut(rows.join(repeated, "anchor"))
    del rows  # what is stored of it can go
    own = F.xxhash64("did", "th", "at")
    # Stored as well, so that a join on a frequent extent can be split: both its sides are plain shuffles.
    within = [F.min("row").alias("lo"), F.max("row").alias("hi")] if words else []
    extents = cut(live.groupBy("anchor", "extent").agg(many, F.min(own).alias("pick"), *within))
    first, more = F.shiftright("at", 24), F.shiftright("at", 12).bitwiseAND(F.lit(4095))
    found = live.join(extents, ["anchor", "extent"]).where("many or varied")
    lo, hi = ("lo", "hi") if words else ("extent", "extent")
    going = F.struct("anchor", F.col(lo).alias("lo"), F.col(hi).alias("hi"), "at", (~F.col("many")).alias("open"), "crowded")
    # An open extent goes on from all its places: one row may have it at several.
    per_document = found.groupBy("did", "th").agg(
        F.collect_list(F.when(F.col("many"), F.struct(first.alias("first"), (first + more).alias("last")))).alias("whole"),
        F.collect_list(F.when(F.col("varied") & (~F.col("many") | (F.col("pick") == own)), going)).alias("extents"),
    )
    per_document = cut(per_document)
    going_on = cut(_extent_rows(_stored(keyed), per_document.where("size(extents) > 0").select("did", "th", "extents"), width, words))
    deep = _in_runs(going_on.where("not crowded"), width, words).unionByName(_by_suffix(going_on.where("crowded"), width, words))
    deep = deep.groupBy("did", "th").agg(F.collect_list(F.struct("first", "last")).alias("more"))
    none: Column = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")
    both = per_document.select("did", "th", "whole").join(deep, ["did", "th"], "full")
    return both.select("did", "th", F.concat(F.coalesce("whole", none), F.coalesce("more", none)).alias("ranges")).where("size(ranges) > 0")


def _runs(ranges: list[dict], width: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of bytes or words that ranges of suffixes cover."""
    out: list[tuple[int, int]] = []
    for x in sorted((x["first"], x["last"] + width) for x in ranges):
        if out and x[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x[1]))
        else:
            out.append(x)
    return out


def without_repeats(documents: DataFrame, width: int = 400, passage: int = 51, **options) -> DataFrame:
    """doc_id, n_bytes, removed (array of byte ranges, end exclusive), kept (binary, what is left) and passages of every document.

    ``passages`` (array of word ranges, end exclusive) are covered by windows of ``passage`` words that another row has as well; they are
    told, not removed.
    """
    ranges = cut(repeated_ranges(documents, width, **options))
    passages = cut(repeated_ranges(documents, passage, -(-passage // 3), options.get("most_rows", 8192), words=True).withColumnRenamed("ranges", "passages"))

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), kind, pa.binary(), kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "removed", "kept", "passages"])

        for b in batches:
            for doc_id, z, ranges, passages in zip(*[b.column(c) for c in ("doc_id", "z", "ranges", "passages")], strict=True):
                raw, runs = _text(z.as_py()), _runs(ranges.as_py() or [], width)
                edges = [0, *[x for run in runs for x in run], len(raw)]
                kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                told = _runs(passages.as_py() or [], passage)
                rows.append((doc_id.as_py(), len(raw), [{"start": s, "end": e} for s, e in runs], kept, [{"start": s, "end": e} for s, e in told]))
                size += len(raw) + 64
                if size >= HELD_BYTES:
                    yield given()
                    rows, size = [], 0
        if rows:
            yield given()

    joined = _stored(_keyed(documents)).join(ranges, ["did", "th"], "left").join(passages, ["did", "th"], "left").select("doc_id", "z", "ranges", "passages")
    spans = "array<struct<start:long,end:long>>"
    return joined.mapInArrow(returning(run), f"doc_id long, n_bytes long, removed {spans}, kept binary, passages {spans}")


def _length(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (the bytes kept, those that are no whole code points as U+FFFD) and n_passage_words of the result of ``without_repeats``."""
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return cleaned.select(
        "doc_id", "n_bytes", _length("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"), _length("passages").alias("n_passage_words")
    )
