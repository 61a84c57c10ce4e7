from __future__ import annotations

import random
import re

import numpy as np
import pytest

from fieldloom.llm import packing
from fieldloom.llm.queries import TOKENIZERS
from fieldloom.llm.tokens import BLANK, rank_encoding, token_ids
from tests.llm import odd

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def restored(rows, length: int) -> dict:
    """Ids of each (doc, piece), checked against lengths, positions and padding on the way."""
    end, out = rank_encoding(RANKS).n_vocab, {}
    for r in rows:
        ids, at = np.frombuffer(r.token_ids, np.uint16), np.frombuffer(r.position_ids, np.uint16)
        assert len(ids) == len(at) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert (ids[r.n_tokens :] == end).all() and (at[r.n_tokens :] == 0).all()
        for k, (doc, piece) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert b > a and (at[a:b] == np.arange(b - a)).all()
            out.setdefault(doc, []).append((piece, ids[a:b]))
    return out


def test_every_token_of_every_text_comes_back(spark):
    rows = packing.pack(odd.documents(spark), RANKS, 256).collect()
    encoding, found = rank_encoding(RANKS), restored(rows, 256)
    assert len({r.sequence_id for r in rows}) == len(rows)
    want: dict = {}
    for doc, text, *_ in odd.TEXTS:
        if text:
            want.setdefault(doc, []).append([*token_ids(encoding, text).tolist(), encoding.n_vocab])
    assert set(found) == set(want)
    for doc, texts in want.items():
        assert sum(len(ids) for _, ids in found[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            assert np.concatenate([ids for _, ids in sorted(found[doc], key=lambda x: x[0])]).tolist() == texts[0]
    assert encoding.decode(np.concatenate([x for _, x in sorted(found[10], key=lambda x: x[0])]).tolist()[:-1]) == dict((r[0], r[1]) for r in odd.TEXTS)[10]


def test_clashing_columns_and_empty_table(spark):
    plain, more = (packing.pack(d.coalesce(1).orderBy("text", "doc_id"), RANKS, 128).select("doc_ids", "token_ids") for d in (odd.documents(spark), odd.crowded(odd.documents(spark))))
    assert odd.sorted_rows(plain) == odd.sorted_rows(more)
    assert packing.pack(odd.empty(spark), RANKS).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_against_a_linear_search(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.choice([1, 7, 64, 100]))
    sizes = rng.integers(1, length + 1, 300)
    rooms: list[int] = []
    for n in sorted(sizes.tolist(), reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(length - n)
    got = packing.best_fit_decreasing(sizes, length)
    assert sorted(i for s in got for i in s) == list(range(300))
    assert sorted(length - int(sizes[s].sum()) for s in got) == sorted(rooms)


def test_little_is_padding(spark):
    rows = packing.pack(odd.documents(spark, [(i, "some words here " * (i % 90 + 1), "en", "a") for i in range(400)]), RANKS, 512).collect()
    assert sum(r.n_tokens for r in rows) / (512 * len(rows)) > 0.9


def test_runs_of_blanks_are_cut_as_the_library_cuts_them():
    """Every run is cut out here, as long ones are, and the ids are the library's own of the whole text."""
    encoding, rng = rank_encoding(RANKS), random.Random(5)
    bits = [" ", "  ", "\n", "\r\n", "\t", "\u3000", "\xa0", "\x85", "\x1c", "\u2028", "a", "Ab", "7", "42", "!", "'s", "'", "é", "🙂", "."]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert token_ids(encoding, text, re.compile(f"{BLANK}+")).tolist() == encoding.encode_ordinary(text)
    for text in (" " * 300_000, "a" + "\n" * 300_000 + " b", "\u3000" * 200_000 + "\nx  y"):
        assert token_ids(encoding, text).tolist() == encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_500_000, "a" + " \n" * 700_000 + "b"])
def test_a_million_blanks(text):
    encoding = rank_encoding(RANKS)
    assert encoding.decode(token_ids(encoding, text).tolist()) == text
