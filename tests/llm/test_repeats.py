from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from fieldloom.llm import repeats
from fieldloom.llm.shared import table
from tests.compare import SMALL
from tests.llm import odd


def by_hand(rows: list[tuple[int | None, str | None]], width: int) -> list[str]:
    """Every string of ``width`` bytes of every whole text, counted by its hash."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(b[k : k + width]) for _, b in raw for k in range(len(b) - width + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[hash(b[k : k + width])] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append(str((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())))
    return sorted(out)


def shown(df) -> list[str]:
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in repeats.digest(df).collect())


def planted(seed: int, docs: int = 60) -> list[tuple[int, str]]:
    """Random texts that share passages of many lengths, some overlapping, periodic or adjacent."""
    rng = random.Random(seed)
    letter = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [letter(n) for n in (39, 40, 41, 60, 90, 300)] + ["ab" * 60, "z" * 130]
    rows = []
    for i in range(docs):
        parts = [letter(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 10)
            parts += [p[a : len(p) - rng.randrange(0, 10)], letter(rng.choice([0, 1, 30]))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("most", [8192, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_by_hand(spark, seed, most):
    rows = planted(seed)
    docs = odd.documents(spark, [(i, t, None, None) for i, t in rows])
    assert shown(repeats.without_repeats(docs, 40, gram=20, most_rows=most)) == by_hand(rows, 40)


def test_odd_rows_by_hand(spark):
    docs = odd.documents(spark)
    want = by_hand([(r[0], r[1]) for r in odd.TEXTS], 400)
    assert shown(repeats.without_repeats(docs)) == want
    assert shown(repeats.without_repeats(odd.crowded(docs))) == want


def test_long_texts_remove_each_other(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.digest(repeats.without_repeats(odd.documents(spark))).collect()}
    assert got[9] == (len(odd.LONG), len(odd.LONG)) and got[12] == (200_000, 200_000) and got[1] == (0, 0)


def test_empty_table(spark):
    assert repeats.digest(repeats.without_repeats(odd.empty(spark))).count() == 0


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_the_table_by_hand(spark, folder):
    docs = table(spark, folder, "documents")
    assert shown(repeats.without_repeats(docs)) == by_hand([(r.doc_id, r.text) for r in docs.collect()], 400)


def test_the_text_given_out_is_what_is_kept(spark):
    docs = odd.documents(spark)
    cleaned = repeats.without_repeats(docs)
    kept = {(r.doc_id, bytes(r.kept).decode("utf-8", "replace")) for r in cleaned.collect()}
    assert {(r.doc_id, r.text) for r in repeats.digest(cleaned).collect()} == kept


def test_widths_that_lengths_of_12_bits_cannot_hold(spark):
    for options in ({"width": 6000}, {"width": 100}, {"width": 400, "gram": 0}):
        with pytest.raises(ValueError):
            repeats.repeated_ranges(odd.documents(spark), **options)


def passages_by_hand(rows: list[tuple[int | None, str | None]], k: int) -> list[str]:
    """Id and number of words covered by windows of ``k`` words that another row has too."""
    words = [odd.WORD.findall(t or "") for _, t in rows]
    owners: dict[int, set[int]] = {}
    for i, w in enumerate(words):
        for a in range(len(w) - k + 1):
            owners.setdefault(hash(tuple(w[a : a + k])), set()).add(i)
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        told = bytearray(len(w))
        for a in range(len(w) - k + 1):
            if len(owners[hash(tuple(w[a : a + k]))]) > 1:
                told[a : a + k] = b"\1" * k
        out.append(str((doc_id, sum(told))))
    return sorted(out)


def told(df) -> list[str]:
    return sorted(str((r.doc_id, r.n_passage_words)) for r in repeats.digest(df).collect())


def planted_words(seed: int, docs: int = 60) -> list[tuple[int | None, str]]:
    """Texts of few words that share passages of many lengths, or repeat some of their own; the last rows are there twice."""
    rng = random.Random(seed)
    word = lambda n: [rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(n)]
    passages = [word(n) for n in (8, 9, 10, 20, 60)] + [["a", "b"] * 15, ["z"] * 30]
    rows: list[tuple[int | None, str]] = []
    for i in range(docs):
        parts, mine = word(rng.randrange(0, 20)), word(12)
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice([*passages, mine])
            a = rng.randrange(0, 3)
            parts += p[a : len(p) - rng.randrange(0, 3)] + word(rng.choice([0, 1, 9]))
        rows.append((i if i % 9 else None, rng.choice([" ", "\n", " \t "]).join(parts)))
    return rows + rows[-3:]


@pytest.mark.parametrize("most", [8192, 2])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_passages_of_words_by_hand(spark, seed, most):
    rows = planted_words(seed)
    docs = odd.documents(spark, [(i, t, None, None) for i, t in rows])
    cleaned = repeats.without_repeats(docs, 40, 8, gram=20, most_rows=most)
    assert told(cleaned) == passages_by_hand(rows, 8)
    assert shown(cleaned) == by_hand(rows, 40)


def test_a_passage_of_over_50_words_is_told_though_it_has_fewer_than_400_bytes(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [(1, f"one {passage} two"), (2, f"three {passage}\nfour"), (3, passage.removesuffix(" w50") + " x"), (4, "y " * 60 + "end"), (5, None)]
    got = repeats.digest(repeats.without_repeats(odd.documents(spark, [(i, t, None, None) for i, t in rows]))).collect()
    assert len(passage.encode()) < 400 and all(r.n_removed == 0 for r in got)
    assert {r.doc_id: r.n_passage_words for r in got} == {1: 51, 2: 51, 3: 0, 4: 0, 5: 0}


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_passages_of_the_table_by_hand(spark, folder):
    docs = table(spark, folder, "documents")
    assert told(repeats.without_repeats(docs)) == passages_by_hand([(r.doc_id, r.text) for r in docs.collect()], 51)


def test_passages_of_odd_rows_by_hand(spark):
    docs = odd.documents(spark)
    assert told(repeats.without_repeats(docs, passage=5)) == passages_by_hand([(r[0], r[1]) for r in odd.TEXTS], 5)
