"""Token sequences packed into fixed lengths: best-fit decreasing, written as binary matrices.

Every document's ids, followed by an end id, are split without loss into pieces of at most
``length``; pieces, longest first, go to the open sequence with the least room that
still takes them. Open sequences are found by their room in a segment tree over rooms.
A sequence comes out as a row of the id matrix (uint16 or int32, filled with the pad id),
cumulative segment lengths, positions that start at 0 in each segment, and which
piece of which document each segment is.

Work is dealt by input partition: a task packs at most ``chunk`` ids at a time, so that its memory is
bounded and nothing is shuffled; sequences left open at the end of a chunk are
written as they are. Which pieces meet in a sequence so depends on how the input is dealt into partitions, and a
sequence's id on its partition; a partition of few ids leaves more padding.

Defined results: null and empty texts have no ids and no segment; null ids are carried as null;
repeated rows are packed each; texts of any length are split, never cut off; an empty table gives no
sequence; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import returning
from fieldloom.llm.tokens import rank_encoding, token_ids

SCHEMA = "sequence_id long, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, n_tokens int, token_ids binary, position_ids binary"


class RoomTree:
    """Which rooms 0..length some open sequence has; finds the least room of at least n in log(length) steps."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << (length + 1 - 1).bit_length() if length else 1
        while self.leaves < length + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) of the least room >= need."""
        node = need + self.leaves
        if not self.count[node]:
            # Up to the first ancestor with something to the right, then down its left edge.
            while node > 1 and (node % 2 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Indices of the pieces in each sequence; every size is 1 to ``length``."""
    tree, out = RoomTree(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        found = tree.take(n)
        if found is None:
            room, at = length, len(out)
            out.append([])
        else:
            room, at = found
        out[at].append(i)
        if room > n:
            tree.add(room - n, at)
    return out


def pack(documents: DataFrame, tokenizer: str, length: int = 2048, chunk: int = 1 << 22, end_id: int | None = None, pad_id: int | None = None) -> DataFrame:
    """Packed sequences of all texts. ``end_id`` follows each document; both ids default to the first one free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(tokenizer)
        end = encoding.n_vocab if end_id is None else end_id
        pad = end if pad_id is None else pad_id
        kind = np.uint16 if max(end, pad, encoding.n_vocab) < 1 << 16 else np.int32
        place = np.uint16 if length <= 1 << 16 else np.int32
        task, done = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, int, np.ndarray]] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, done
            sizes = np.array([len(x[2]) for x in held], dtype=np.int64)
            packed = best_fit_decreasing(sizes, length)
            for a in range(0, len(packed), 256):
                rows: list[list] = [[] for _ in range(7)]
                for members in packed[a : a + 256]:
                    ids, at, cu = np.full(length, pad, dtype=kind), np.zeros(length, dtype=place), [0]
                    for m in members:
                        n = int(sizes[m])
                        ids[cu[-1] : cu[-1] + n] = held[m][2]
                        at[cu[-1] : cu[-1] + n] = np.arange(n)
                        cu.append(cu[-1] + n)
                    for row, x in zip(rows, ((task << 33) + done, [held[m][0] for m in members], [held[m][1] for m in members], cu, cu[-1], ids.tobytes(), at.tobytes()), strict=True):
                        row.append(x)
                    done += 1
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["sequence_id", "doc_ids", "pieces", "cu_seqlens", "n_tokens", "token_ids", "position_ids"])
            held, waiting = [], 0

        for b in batches:
            for name, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                ids = np.append(token_ids(encoding, text), np.uint32(end)).astype(kind)
                name = name.as_py()
                for piece, a in enumerate(range(0, len(ids), length)):
                    held.append((name, piece, ids[a : a + length]))
                waiting += len(ids)
                if waiting >= chunk:
                    yield from flush()
        if held:
            yield from flush()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(returning(run), SCHEMA)
