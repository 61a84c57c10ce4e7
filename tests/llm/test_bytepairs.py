"""Ids held against the library that reads the same file of ranks, and decoded back."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from fieldloom.llm import bytepairs
from fieldloom.llm.queries import TOKENIZERS, op13_byte_bpe
from fieldloom.llm.shared import table
from fieldloom.llm.tokens import rank_encoding
from tests.compare import SMALL
from tests.llm import odd

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
MULTI = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
ALPHABETS = ["ab", "ab \n\t'", "abcdefghijklmnopqrstuvwxyz", "éßñ漢字🙂a 1'sre \xa0\x85\x1c", "th er in an  ", "-=_*", "0123456789., "]


@pytest.fixture(params=[PATH, MULTI])
def both(request):
    return bytepairs.vocabulary(request.param), rank_encoding(request.param)


def test_random_texts(both):
    ours, library = both
    rng = random.Random(7)
    texts = ["".join(rng.choice(a) for _ in range(n)) for _ in range(60) for a in ALPHABETS for n in (0, 1, 2, 7, 40, 700)]
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert ours.decode(ids.tolist()) == text.encode()


def test_rows_of_their_own_merge_in_the_same_order(both):
    ours, library = both
    rng = random.Random(8)
    for a in ["ab", "xX", "aabb", "etaoins", "abcdefghijklmnopqrstuvwxyz", "01", "-="]:
        for n in (2, 3, 5, 17, 90, 800):
            piece = "".join(rng.choice(a) for _ in range(n)).encode()
            want = ours._matrix([piece], n)[0]
            assert ours._row(piece).astype(np.int32).tobytes() == want
            if len(library._encode_single_piece(piece)) > 1:
                assert np.frombuffer(want, np.int32).tolist() == library._encode_single_piece(piece)


def test_a_smaller_rank_between_occurrences_comes_first():
    """ab makes token 300 and, with a c or an a after it, tokens of smaller ranks."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 260, b"aba": 261, b"ab": 300, b"xx": 301, b"xxx": 302, b"bab": 303}
    ours = bytepairs.BytePairs(ranks)

    def one_by_one(piece: bytes) -> list[int]:
        parts = [bytes([b]) for b in piece]
        while True:
            found = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks), default=None)
            if found is None:
                return [ranks[p] for p in parts]
            i = found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(9)
    for _ in range(400):
        piece = "".join(rng.choice("abcx") for _ in range(rng.choice([1, 4, 30, 200]))).encode()
        assert ours._row(piece).tolist() == one_by_one(piece)
        assert np.frombuffer(ours.merged([piece])[0], np.int32).tolist() == one_by_one(piece)


def test_cuts_and_memory_make_no_difference(monkeypatch):
    monkeypatch.setattr(bytepairs, "REMEMBER", 3)
    ours = bytepairs.BytePairs({t: i for t, i in rank_encoding(PATH)._mergeable_ranks.items()})
    texts = [t for _, t, _, _ in odd.TEXTS if t and len(t) < 300_000] + ["a  b", " a", "a ", "a \n b", "\n b", " 's x's", "don't  do", "  "]
    for _ in range(2):
        assert [x.tolist() for x in ours.encode(texts)] == [rank_encoding(PATH).encode_ordinary(t) for t in texts]


def test_query_against_the_library(spark):
    library = rank_encoding(PATH)
    got = {r.doc_id: r for r in op13_byte_bpe(spark, SMALL).collect()}
    rows = table(spark, SMALL, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_odd_rows(spark):
    rows = odd.documents(spark)
    out = bytepairs.round_trip(odd.crowded(rows).drop("ids"), PATH).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, bytes(r.decoded)) for r in out)) == sorted((i is None, i or 0, (t or "").encode()) for i, t, _, _ in odd.TEXTS)
    assert all(len(r.ids) == 0 for r in out if not r.decoded)
    kept = set(out[0].asDict())
    assert {"kept", "rank", "source"} <= kept and "text" not in kept
    assert bytepairs.digest(odd.empty(spark), PATH).collect() == []


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "héllo wörld"), (2, None), (3, "<|endoftext|>")], "doc_id long, text string")
    encoded = bytepairs.encode(df, PATH)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bytepairs.decode(encoded, PATH).collect()} == {1: "héllo wörld", 2: "", 3: "<|endoftext|>"}
    assert {r.doc_id: r.ids for r in encoded.collect()}[3] == rank_encoding(PATH).encode_ordinary("<|endoftext|>")
