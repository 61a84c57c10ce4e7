"""Vectorised word and shingle hashing over Arrow string columns.

Every function works on whole Arrow batches: a batch is cut into slices of
whole documents (``slices``), each slice is one contiguous run of UTF-8 bytes,
and words, their hashes and their windows come out as flat numpy arrays with
per-document counts. Memory per slice is about 40 bytes per byte of text, and
a slice holds ``SLICE_BYTES`` or one document, whichever is larger.

A word is a maximal run of bytes other than space and 0x09-0x0D, which is the
same as ``[^\\x20\\x09-\\x0D]+`` on code points because UTF-8 never uses those
bytes inside a longer sequence. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20_240_117)
#: A random 64-bit value for each byte; the second table gives A-Z those of a-z.
_EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole rows of about ``limit`` bytes."""
    done = 0
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        part = part.fill_null("").cast(pa.large_string())
        n = len(part)
        if not n:
            continue
        _, offsets, data = part.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[part.offset : part.offset + n + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
            yield done + a, raw[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b
        done += n


@dataclass
class Words:
    starts: np.ndarray  # byte position of each word in the slice
    ends: np.ndarray
    counts: np.ndarray  # words of each document
    hashes: np.ndarray  # 64 bits each
    first: np.ndarray  # index of each document's first word, and the total at the end


def prefix_hash(data: np.ndarray, table: np.ndarray = _EXACT) -> np.ndarray:
    """P with P[j] - P[i] the polynomial hash of data[i:j], times base^i; 64-bit data (hashes of words) is its own table."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data if data.dtype == np.uint64 else table[data]) * _power_table(_BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of the bytes of each range."""
    inverse = _power_table(_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def words(data: np.ndarray, off: np.ndarray, fold: bool = False) -> Words:
    """Words of a slice; ``fold`` hashes A-Z as a-z."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1 : n + 1] = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    starts = np.flatnonzero(inside[1 : n + 1] & (~inside[:n] | edge[:n]))
    ends = np.flatnonzero(inside[1 : n + 1] & (~inside[2:] | edge[1:])) + 1
    first = np.searchsorted(starts, off)
    prefix = prefix_hash(data, _FOLDED if fold else _EXACT)
    return Words(starts, ends, np.diff(first), range_hash(prefix, starts, ends), first)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k words that stays in its document, and its first word."""
    n = len(w.hashes)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = w.hashes[: n - k + 1].copy()
    for i in range(1, k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w.hashes[i : n - k + 1 + i]
    document = np.repeat(np.arange(len(w.counts)), w.counts)
    whole = np.flatnonzero(document[: n - k + 1] == document[k - 1 :])
    return mix(h[whole]), whole


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; all its words as one where it has fewer than k."""
    h, at = windows(w, k)
    bounds = np.searchsorted(at, w.first)
    out = []
    for d, count in enumerate(w.counts):
        if count >= k:
            out.append(np.unique(h[bounds[d] : bounds[d + 1]]))
        elif count:
            value = np.uint64(count)
            with np.errstate(over="ignore"):
                for x in w.hashes[w.first[d] : w.first[d + 1]]:
                    value = value * np.uint64(0xA0761D6478BD642F) + x
            out.append(mix(np.array([value], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
