"""Byte-level BPE over padded matrices, and back.

A text is split by the pattern of its vocabulary; each match ("piece") that is no token itself starts as a row of byte ids.
Pieces are dealt into buckets by length and stacked as padded matrices. In every round each row merges its leftmost pair of
the least rank, found by an open-addressing hash table from pairs of ids to the rank of what they make, and closes the gap
(so a matrix loses a column a round); rows without a pair are done. A piece of more than ``LONG`` bytes is a matrix of one
row that merges, in a round, all occurrences of its least pair from the left, as far as no pair of a smaller rank comes up
between them: the same merges in the same order as one a round, without a round for each.

Most texts repeat their words, so a text is first cut before each single space that is followed by something else than a blank
(a match of the pattern always starts there, and nothing before it looks across), and a worker remembers the ids of at most
``REMEMBER`` such cuts. Workers open the file of ranks once each; on a cluster its path must be readable on every worker.

Defined results: null and empty texts have no ids and decode to no bytes; texts and pieces of any length are encoded whole;
text that looks like a special token is text; null ids, repeated rows and other columns are carried as they are; an empty
table gives no rows. Ids that the vocabulary doesn't have can't be decoded and raise.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import returning
from fieldloom.llm.tokens import SPLIT

#: Bytes of a piece beyond which it is a matrix of its own.
LONG = 512
#: Cells of a matrix at most.
CELLS = 1 << 17
#: Cuts of texts whose ids a worker keeps at most, and the characters of such a cut.
REMEMBER = 1 << 19
REMEMBERED = 64
#: Characters of text worked on at once, or one text.
SLICE = 1 << 20
NONE = np.int32(2**31 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Pairs of ids to ranks: open addressing, half full at most, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(2 * max(1, len(rank)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        key = left.astype(np.int64) << 31 | right.astype(np.int64)
        at, open_ = self._home(key), np.arange(len(key))
        while len(open_):
            free = open_[self.keys[at[open_]] == -1]
            self.keys[at[free]] = key[free]  # of several that want a slot the last one has it
            own = free[self.keys[at[free]] == key[free]]
            self.ranks[at[own]] = rank[own]
            open_ = open_[self.keys[at[open_]] != key[open_]]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none or an id is negative."""
        key = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) << 31 | right.astype(np.int64))
        at = self._home(key)
        out = np.where(self.keys[at] == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1) & (key >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at] == key[open_]
            out[open_[found]] = self.ranks[at[found]]
            more = ~found & (self.keys[at] != -1)
            open_, at = open_[more], at[more]
        return out


class BytePairs:
    """A vocabulary of ranks: a token's id is its rank, and two ids merge if the bytes of both together are a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT) -> None:
        self.pieces = regex.compile(pattern)
        self.bytes = {i: token for token, i in ranks.items()}
        if max(self.bytes, default=0) >= NONE or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be below 2^31 - 1 and cover every byte")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        made = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(made, dtype=np.int64).reshape(-1, 3).T)
        text = {token: token.decode(errors="replace") for token in ranks}
        #: Tokens that are whole characters, which pieces can be.
        self.whole = {t: np.int32(ranks[token]).tobytes() for token, t in text.items() if t.encode() == token}
        self.known: dict[str, bytes] = {}

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, as one padded matrix."""
        out = [b""] * len(pieces)
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        flat, size = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.array(list(map(len, pieces)))
        ids[np.arange(width) < size[:, None]] = self.single[flat]
        rank, row = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1), np.arange(len(pieces))
        while True:
            at = rank.argmin(1)
            least = rank[np.arange(len(row)), at]
            go = least < NONE
            if not go.all():
                done = ids[~go]
                for r, x in zip(row[~go].tolist(), _bytes_of(done[done >= 0], (done >= 0).sum(1)), strict=True):
                    out[r] = x
                ids, rank, row, at, least = ids[go], rank[go], row[go], at[go], least[go]
            if not len(row):
                return out
            every = np.arange(len(row))
            ids[every, at] = least
            place = np.arange(ids.shape[1] - 1)
            ids = np.where(place <= at[:, None], ids[:, :-1], ids[:, 1:])
            # One column of ranks more than of pairs, so that there is always one.
            rank = np.where(place <= at[:, None], rank, np.append(rank[:, 1:], np.full((len(row), 1), NONE), axis=1))
            ends = np.append(ids, np.full((len(row), 1), -1, dtype=np.int32), axis=1)
            rank[every, at] = self.pairs(least, ends[every, at + 1])
            before = every[at > 0]
            rank[before, at[before] - 1] = self.pairs(ids[before, at[before] - 1], least[before])
            rank = rank[:, : max(1, ids.shape[1] - 1)]

    def _row(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece. Merged ids stay where they were; ``after`` and ``before`` lead past what they took in."""
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)]
        while True:
            n = len(ids)
            rank = np.append(self.pairs(ids[:-1], ids[1:]), NONE).astype(np.int32)
            after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
            alive = n
            while alive > n // 2:
                least = rank.min()
                if least == NONE:
                    return ids[ids >= 0]
                at = np.flatnonzero(rank == least)
                # Of occurrences that share an id, one after the other, every second goes.
                first = np.append(True, after[at[:-1]] != at[1:])
                start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
                second = after[at]
                left, right = before[at], after[second]
                taken = np.append(False, left[1:] == second[:-1])  # the id before is one just made
                was = np.where(left >= 0, ids[left], -1)
                to_left = self.pairs(np.where(taken, least, was), np.full(len(at), least))
                to_right = self.pairs(np.full(len(at), least), np.where(right < n, np.append(ids, -1)[right], -1))
                early = np.flatnonzero((to_left < least) | (to_right < least))
                if len(early):
                    at, second, left, right = (x[: early[0] + 1] for x in (at, second, left, right))
                ids[at], ids[second], rank[second] = least, -1, NONE
                after[at] = right
                before[right[right < n]] = at[right < n]
                ends = np.append(ids, -1)
                rank[at] = self.pairs(ids[at], ends[right])
                some = left[left >= 0]
                some = np.where(ids[some] >= 0, some, before[some])
                rank[some] = self.pairs(ids[some], ends[after[some]])
                alive -= len(at)
            ids = ids[ids >= 0]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece by merges alone, four bytes each."""
        out = [b""] * len(pieces)
        size = np.array(list(map(len, pieces)), dtype=np.int64)
        bucket = np.where(size > LONG, 0, 1 << np.ceil(np.log2(np.maximum(size, 4))).astype(np.int64))
        for width in np.unique(bucket).tolist():
            own = np.flatnonzero(bucket == width)
            step = max(1, CELLS // width) if width else 1
            for a in range(0, len(own), step):
                part = own[a : a + step].tolist()
                found = self._matrix([pieces[i] for i in part], width) if width else [self._row(pieces[part[0]]).astype(np.int32).tobytes()]
                for i, ids in zip(part, found, strict=True):
                    out[i] = ids
        return out

    def _ids(self, pieces: list[list[str]]) -> list[bytes]:
        """Ids of lists of pieces, four bytes each."""
        own = {p: self.whole.get(p) for p in set(chain.from_iterable(pieces))}
        rest = [p for p, x in own.items() if x is None]
        own.update(zip(rest, self.merged([p.encode() for p in rest]), strict=True))
        return [b"".join([own[p] for p in part]) for part in pieces]

    def _learn(self, cuts: list[str]) -> dict[str, bytes]:
        """Ids of each cut with a space before it. Only the first piece of a cut starts with a space, so one search splits them all."""
        found = self.pieces.findall(" " + " ".join(cuts)) if cuts else []
        starts = [i for i, p in enumerate(found) if p[0] == " "]
        return dict(zip(cuts, self._ids([found[a:b] for a, b in zip(starts, [*starts[1:], len(found)], strict=True)]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of whole texts."""
        heads, rests = [], []
        for t in texts:
            head, *rest = [t] if _NO_CUT.search(t) else t.split(" ")
            heads.append(self.pieces.findall(head))
            rests.append(rest)
        found = [list(map(self.known.get, rest)) for rest in rests]
        fresh = list({c for rest, x in zip(rests, found, strict=True) if None in x for c, ids in zip(rest, x, strict=True) if ids is None})
        learned: dict[str, bytes] = {}
        for a in range(0, len(fresh), 1 << 15):
            learned |= self._learn(fresh[a : a + (1 << 15)])
        out = []
        for head, rest, x in zip(self._ids(heads), rests, found, strict=True):
            out.append(np.frombuffer(b"".join([head, *[learned[c] if ids is None else ids for c, ids in zip(rest, x, strict=True)]]), dtype=np.int32))
        if len(self.known) > REMEMBER:
            self.known.clear()
        self.known.update((c, x) for c, x in learned.items() if len(c) <= REMEMBERED)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


#: A space with a blank or nothing after it: such a text isn't cut.
_NO_CUT = re.compile(r" (?:\s|\Z)")


def _bytes_of(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Runs of ``counts`` ids, four bytes each."""
    whole, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> BytePairs:
    """The vocabulary of a file of ranks: on each line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return BytePairs({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows with some ``SLICE`` bytes."""
    size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, size[a] + SLICE, side="right")) - 1)
        yield a, [x or "" for x in texts[a:b].to_pylist()]
        a = b


def _lists(ids: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))


def _with(df: DataFrame, source: str, added: dict[str, str], run: Callable[[pa.Array], Iterator[tuple[int, list[pa.Array]]]]) -> DataFrame:
    """``df`` without ``source``, with the columns ``added`` (names and types) that ``run`` makes of it, some rows at a time."""
    rows = df.select(*[c for c in df.columns if c != source and c not in added], source)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, made in run(b.column(b.num_columns - 1)):
                yield pa.RecordBatch.from_arrays([*[c.slice(a, len(made[0])) for c in b.columns[:-1]], *made], [*b.schema.names[:-1], *added])

    kinds = [f"`{c}` {kind}" for c, kind in rows.dtypes[:-1]] + [f"{c} {kind}" for c, kind in added.items()]
    return rows.mapInArrow(returning(whole), ", ".join(kinds))


def encode(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``documents`` with the ids of each text in ``ids`` in place of the text."""

    def run(texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for a, some in _slices(texts):
            yield a, [_lists(vocabulary(path).encode(some))]

    return _with(documents.withColumn(text, F.col(text).cast("string")), text, {"ids": "array<int>"}, run)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the bytes that its ``ids`` stand for in ``decoded`` in place of the ids."""

    def run(ids: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for a in range(0, len(ids), 64):
            yield a, [pa.array([vocabulary(path).decode(x or []) for x in ids[a : a + 64].to_pylist()], pa.binary())]

    return _with(encoded, "ids", {"decoded": "binary"}, run)


def round_trip(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``documents`` with ``ids`` and the bytes they decode to, in place of the text; both by one worker."""

    def run(texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for a, some in _slices(texts):
            ids = vocabulary(path).encode(some)
            yield a, [_lists(ids), pa.array([vocabulary(path).decode(x.tolist()) for x in ids], pa.binary())]

    return _with(documents.withColumn(text, F.col(text).cast("string")), text, {"ids": "array<int>", "decoded": "binary"}, run)


def digest(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids in decimal and of the bytes they decode to."""
    both = round_trip(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
