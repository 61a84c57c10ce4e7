"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here: pieces with their scores and kinds, the trainer's model
type and byte fallback, the normaliser's settings. From them a tokenizer is rebuilt: the
normaliser (character map, spaces, metaspace marker), the unigram scores or, for a BPE
model, the merges that its scores order, byte fallback, and the decoder.

``encode`` runs batches through it, multithreaded. Where no piece of the model continues after
a space (checked against the pieces), the text is cut before each run of spaces, which
can't change the result of either library, and each distinct cut is encoded once while it is
remembered. All ids can be held against the SentencePiece library's (``parity``): cut by cut, or
text by text where texts aren't cut; and every decoded text against its own (``round_trip``).
Decoding puts together what each id gives, decoded once, and decodes runs of bytes as they come.

Defined results: null and empty texts give no ids, parity and round trip true; repeated rows
are encoded each; texts of any length are encoded whole; an empty table gives an
empty result; other columns are not read. The path must be readable on every worker.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from fieldloom.llm.shared import returning, short_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE_BYTES = 15_000_000  # of the keys that a worker remembers in a generation, KEY_BYTES being added for each
KEY_BYTES = 80
THREADS = 2  # of the tokenizers library in a worker, where the environment names no number; tasks share an executor's cores
CHUNK = 1 << 19  # bytes of texts or ids that are worked on at a time


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; varints, 32 and 64 bit values as int."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[wire]
            yield number, int.from_bytes(data[at : at + n], "little")
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                m.pieces.append((own[1].decode("utf-8"), struct.unpack("<f", own.get(2, 0).to_bytes(4, "little"))[0], own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                m.model_type, m.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                m.char_map, m.dummy_prefix, m.squeeze, m.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        return m

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def separable(self) -> bool:
        """Whether no piece has the space marker after another character."""
        return self.escape and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER, UNUSED))

    def merges(self) -> list[tuple[str, str]]:
        """Every way to make a piece of two, in the order of the whole's score; of ways to one piece that with the longest left part comes first.

        The SentencePiece library takes the leftmost of pairs of one score. In a run of one character, where such pairs overlap, that order of the ways
        gives the same.
        """
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        ways = []
        for whole, i in ids.items():
            score = self.pieces[i][1]
            ways += [(-score, -k, i, whole) for k in range(1, len(whole)) if whole[:k] in ids and whole[k:] in ids]
        return [(whole[:-left], whole[-left:]) for _, left, _, whole in sorted(ways)]  # left is negative

    def normalizer(self, prefix: bool = True) -> normalizers.Normalizer:
        steps: list = []
        if self.char_map:
            steps.append(normalizers.Precompiled(self.char_map))
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if self.dummy_prefix and prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    def tokenizer(self) -> Tokenizer:
        vocab = [(p, s) for p, s, _ in self.pieces]
        if self.model_type == BPE:
            model = models.BPE(vocab={p: i for i, (p, _) in enumerate(vocab)}, merges=self.merges(), unk_token=vocab[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram(vocab, self.unknown, self.byte_fallback)
        t = Tokenizer(model)
        t.encode_special_tokens = True
        t.decoder = decoders.Sequence([*([decoders.Metaspace(MARK, "never")] if self.escape else []), decoders.ByteFallback(), decoders.Fuse()])
        return t


class Recent:
    """Values worked out for recent keys: two generations, of about ``size`` bytes of keys each and what one call asks for."""

    def __init__(self, work: Callable[[list], Iterable], size: int) -> None:
        self.work, self.size = work, size
        self.forget()

    def forget(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def know(self, keys: set) -> dict:
        """A dictionary that has all of ``keys``."""
        if self.held > self.size:
            self.old, self.young, self.held = self.young, {}, 0
        missing = keys.difference(self.young)
        again = missing.intersection(self.old)
        self.young.update((k, self.old[k]) for k in again)
        new = list(missing - again)
        self.young.update(zip(new, self.work(new), strict=True))
        self.held += sum(map(len, missing)) + KEY_BYTES * len(missing)
        return self.young


class Codec:
    """Encodes and decodes batches with the model at a path; ``verify`` holds the ids of each cut against the library when first met."""

    def __init__(self, path: str, verify: bool = False) -> None:
        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        self.verify = verify
        self.tokenizer = self.model.tokenizer()
        self.normalizer = self.model.normalizer()
        self.cuts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.model.separable() else None
        #: What each id gives on its own. Only runs of bytes depend on their neighbours.
        self.alone = self._decoded(np.arange(len(self.model.pieces), dtype=np.int32)[:, None])
        self.byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        self.seen = Recent(self._encoded, CACHE_BYTES)
        self.odd: set[str] = set()  # cuts whose ids differ from the library's
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Without a character map and squeezing, normalising is a prefix and a replacement.
        self.plain = not self.model.char_map and not self.model.squeeze and self.model.escape

    def normalized(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:
            return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        return self.normalizer.normalize_str(text)

    def _encoded(self, cuts: list[str]) -> list[bytes]:
        found = [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(cuts, add_special_tokens=False)]
        if self.verify and self.plain:
            self.odd.update(p for p, ids, theirs in zip(cuts, found, self._library(cuts), strict=True) if array("i", theirs).tobytes() != ids)
        return found

    def _decoded(self, ids: Iterable[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[str]] | None]:
        """Ids of each text, and its cuts where texts are cut."""
        normal = [self.normalized(t) for t in texts]
        if self.cuts is None:
            return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(normal, add_special_tokens=False)], None
        parts = [self.cuts.findall(t) for t in normal]
        known = self.seen.know(set().union(*parts))
        return [np.frombuffer(b"".join(map(known.__getitem__, text)), dtype=np.int32) for text in parts], parts

    def _library(self, cuts: list[str]) -> list[list[int]]:
        """The SentencePiece library's ids of cuts. It puts a space before a text, so the cut's own first one is left out."""
        bare = [p[1:] if self.model.dummy_prefix else p for p in cuts]
        out = self.reference.encode([p.replace(MARK, " ") for p in bare], num_threads=1)
        for i, p in enumerate(bare):
            if not p:  # a single space: what it adds to a text
                out[i] = self.reference.encode("x ")[len(self.reference.encode("x")) :]
        return out

    def parity(self, texts: list[str], ids: list[np.ndarray], parts: list[list[str]] | None) -> list[bool]:
        """Whether each text's ids are the library's: by its cuts, or by the whole text."""
        if parts is not None and self.plain:
            return [not self.odd or self.odd.isdisjoint(p) for p in parts]
        return [x.tobytes() == array("i", y).tobytes() for x, y in zip(ids, self.reference.encode(texts, num_threads=1), strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids: what each id gives, runs of bytes being decoded as a whole."""
        flat = np.concatenate([np.empty(0, np.int32), *ids])
        bounds = np.cumsum([0, *map(len, ids)])
        shown = list(map(self.alone.__getitem__, flat.tolist()))
        at = np.flatnonzero(self.byte[flat])
        if len(at):
            begins = np.concatenate([[True], (np.diff(at) > 1) | np.isin(at[1:], bounds)])
            first, end = at[begins], at[np.append(begins[1:], True)] + 1
            for a, b, text in zip(first.tolist(), end.tolist(), self._decoded(flat[a:b] for a, b in zip(first, end, strict=True)), strict=True):
                shown[a:b] = [text] + [""] * (b - a - 1)
        texts = ["".join(shown[a:b]) for a, b in pairwise(bounds.tolist())]
        return [t[1:] if t.startswith(" ") else t for t in texts] if self.model.dummy_prefix else texts

    def expected(self, text: str) -> str:
        """What decoding must give back: the text itself where normalising only marks spaces."""
        if self.plain and self.model.dummy_prefix:
            return text
        n = self.normalized(text).replace(MARK, " ")
        return n[1:] if self.model.dummy_prefix and n else n


@lru_cache(maxsize=2)
def codec(path: str, verify: bool = False) -> Codec:
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return Codec(path, verify)


def _chunks(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows, of about ``CHUNK`` units of ``sizes`` or a single row."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode(documents: DataFrame, path: str, verify: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (int32, little-endian), parity and round_trip of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, verify)
        for whole in batches:
            for b in _chunks(whole, _sizes(whole.column(1))):
                texts = [t or "" for t in b.column(1).to_pylist()]
                ids, parts = c.encode(texts)
                same = back = [None] * len(texts)
                if verify:
                    same = c.parity(texts, ids, parts)
                    back = [x == c.expected(t) for x, t in zip(c.decode(ids), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())], ["doc_id", "n_tokens", "ids", "parity", "round_trip"])
        c.seen.forget()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return short_batches(rows).mapInArrow(returning(run), "doc_id long, n_tokens int, ids binary, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for b in _chunks(whole, _sizes(whole.column(1))):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.decode([np.frombuffer(x or b"", np.int32) for x in b.column(1).to_pylist()]), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(returning(run), "doc_id long, text string")
