from __future__ import annotations

import random
import struct

import numpy as np
import pytest
import sentencepiece

from fieldloom.llm import pieces
from fieldloom.llm.queries import TOKENIZERS
from fieldloom.llm.shared import table
from tests.compare import SMALL
from tests.llm import odd

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def number(key: int, n: int) -> bytes:
    return varint(key << 3) + varint(n)


def blob(key: int, data: bytes) -> bytes:
    return varint(key << 3 | 2) + varint(len(data)) + data


def model_bytes(vocab: list[tuple[str, float, int]], fallback: bool) -> bytes:
    """A unigram model written by hand, with scores of our own; the normaliser only marks spaces."""
    body = b"".join(blob(1, blob(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, kind)) for p, s, kind in vocab)
    trainer = number(3, pieces.UNIGRAM) + number(35, int(fallback))
    normal = blob(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1)
    return body + blob(2, trainer) + blob(3, normal)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory) -> str:
    rng = random.Random(3)
    found = {"".join(rng.choice("abcde▁") for _ in range(rng.randrange(2, 5))) for _ in range(150)} | set("abcde▁éf")
    vocab = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    vocab += [(f"<0x{i:02X}>", 0.0, pieces.BYTE) for i in range(256)]
    vocab += [(p, -1.0 - 0.0137 * k * (1 + len(p) % 3), pieces.NORMAL) for k, p in enumerate(sorted(found))]
    path = tmp_path_factory.mktemp("model") / "own.model"
    path.write_bytes(model_bytes(vocab, True))
    return str(path)


def test_odd_texts_against_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = odd.documents(spark)
    rows = pieces.encode(docs, PATH)
    got = sorted(str((r.doc_id, np.frombuffer(r.ids, np.int32).tolist())) for r in rows.collect())
    assert got == sorted(str((i, lib.encode(t or ""))) for i, t, *_ in odd.TEXTS)
    assert all(r.parity and r.round_trip and r.n_tokens == len(r.ids) // 4 for r in rows.collect())
    assert odd.sorted_rows(rows) == odd.sorted_rows(pieces.encode(odd.crowded(docs), PATH))
    back = pieces.decode(rows, PATH)
    assert odd.sorted_rows(back) == sorted(str((i, t or "")) for i, t, *_ in odd.TEXTS)


def test_random_texts_against_the_library():
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Codec(PATH, True)
    rng = random.Random(0)
    bits = ["the", "ing", " ", "  ", "\n", "\t", "é", "🙂", "▁", "x▁", "<s>", "</s>", "<unk>", "<0x41>", "12", "  a", " ", "Ω", "ﬁ", "\x00", "-", "한국", " ."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)]
    ids, parts = codec.encode(texts)
    differs = [t for t, x in zip(texts, ids, strict=True) if x.tolist() != lib.encode(t)]
    assert not [t for t in differs if "▁" not in t]
    assert all(p == (x.tolist() == lib.encode(t)) for t, x, p in zip(texts, ids, codec.parity(texts, ids, parts), strict=True) if "▁" not in t)


def test_the_table_against_the_library(spark):
    rows = pieces.encode(table(spark, SMALL, "documents"), PATH).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    assert all(np.frombuffer(r.ids, np.int32).tolist() == lib.encode(texts[r.doc_id] or "") for r in rows)


def test_a_unigram_model_by_hand(spark, unigram):
    m = pieces.Model.parse(open(unigram, "rb").read())
    assert m.model_type == pieces.UNIGRAM and m.byte_fallback and m.dummy_prefix and not m.squeeze
    lib, rng = sentencepiece.SentencePieceProcessor(model_file=unigram), random.Random(1)
    texts = ["".join(rng.choice("abcdeéfg 🙂") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    ids, _ = pieces.Codec(unigram).encode(texts)
    assert [lib.decode(x.tolist()) for x in ids] == [lib.decode(lib.encode(t)) for t in texts]
    score = lambda x: sum(lib.get_score(int(i)) for i in x)
    for t, x in zip(texts, ids, strict=True):
        assert x.tolist() == lib.encode(t) or score(x) == pytest.approx(score(lib.encode(t)), abs=1e-3)


def test_a_wrong_id_is_seen():
    codec = pieces.Codec(PATH, True)
    right = codec.tokenizer

    class Wrong:
        def encode_batch_fast(self, cuts, **options):
            return right.encode_batch_fast(["▁an" if c == "▁the" else c for c in cuts], **options)

        decode_batch = right.decode_batch

    codec.tokenizer = Wrong()
    ids, parts = codec.encode(["in the", "in a"])
    assert codec.parity(["in the", "in a"], ids, parts) == [False, True]
    assert codec.decode(ids) == ["in an", "in a"]


def test_decoding_by_pieces_is_that_of_the_whole():
    codec, rng = pieces.Codec(PATH), np.random.default_rng(0)
    ids = [rng.integers(3, 32_000, rng.integers(0, 30)).astype(np.int32) for _ in range(500)]
    ids += [rng.integers(3, 300, rng.integers(0, 30)).astype(np.int32) for _ in range(500)]  # bytes, mostly
    whole = codec.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
    assert codec.decode(ids) == [t[1:] if t.startswith(" ") else t for t in whole]
    assert codec.decode([]) == [] and codec.decode([np.empty(0, np.int32)]) == [""]


def test_what_is_forgotten_is_worked_out_again():
    calls: list[str] = []

    def work(keys):
        calls.extend(keys)
        return [k.upper() for k in keys]

    memo = pieces.Recent(work, 3 * pieces.KEY_BYTES)
    for k in "abcdeabcde":
        assert memo.know({k})[k] == k.upper()
    assert len(memo.young) <= 4 and 5 <= len(calls) <= 10
    memo.forget()
    assert memo.know({"a"})["a"] == "A"


def test_empty_table(spark):
    assert pieces.encode(odd.empty(spark), PATH).count() == 0


def test_runs_of_one_character_against_the_library():
    """Where pairs of one score overlap, the library takes the leftmost."""
    c = pieces.Codec(PATH, verify=True)
    texts = [x * n for x in (" ", "a", "=", "-", "ab", "na", "0", "\n") for n in range(1, 200)] + [" " * n + "word" for n in range(1, 120)]
    ids, parts = c.encode(texts)
    assert all(x.tolist() == c.reference.encode(t) for x, t in zip(ids, texts, strict=True))
    assert all(c.parity(texts, ids, parts))
