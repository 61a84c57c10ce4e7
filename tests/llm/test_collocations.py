"""Phrases against brute force: every window counted."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from fieldloom.llm import collocations as C
from fieldloom.llm.queries import op12_collocations
from fieldloom.llm.shared import table
from tests.compare import SMALL
from tests.llm import odd


def brute(rows, longest=4, least=30, covered=80, most=2000) -> list[tuple]:
    """rows: (lang, text)."""
    f: dict[str, Counter] = {}
    n: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", odd.lower(text)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= covered * counts[p[i : i + m]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(df) -> list[tuple]:
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def sentences(seed: int, n: int, words: str = "a b é x") -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(words.split()) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(400)) for _ in range(n)]


def test_whole_table_against_brute_force(spark):
    want = brute([(r.lang, r.text) for r in table(spark, SMALL, "documents").select("lang", "text").collect()])
    assert len(want) > 20
    assert found(op12_collocations(spark, SMALL)) == want


@pytest.mark.parametrize("bits", [12, 24])
def test_bitmaps_never_keep_a_phrase_out(spark, bits):
    """Also where nearly every bucket is full."""
    rows = [(i, t, [None, "fr", "de"][i % 3]) for i, t in enumerate(sentences(3, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    want = brute([(x, t) for _, t, x in rows])
    assert any(len(r[2].split(" ")) > 2 for r in want)
    assert found(C.collocations(df, bits=bits)) == want
    assert found(C.collocations(df, longest=3, least=7, covered=50, most=5, bits=bits)) == brute([(x, t) for _, t, x in rows], 3, 7, 50, 5)


def test_chunks_end_where_texts_do(spark):
    """A phrase never goes on in the next text, nor over the end of a piece, and a covered phrase goes even by a dropped one."""
    text = "New York City Hall. New York; City\x0bHall " + "z" * 5000
    df = spark.createDataFrame([(text, "en")] * 40 + [("york", "en"), ("city", "en")], "text string, lang string").coalesce(1)
    want = brute([("en", text)] * 40 + [("en", "york"), ("en", "city")])
    assert len(want) == 3
    assert found(C.collocations(df)) == want


def test_odd_rows(spark):
    rows = odd.crowded(odd.documents(spark, odd.TEXTS * 2)).coalesce(4)
    want = brute([(lang, t) for _, t, lang, _ in odd.TEXTS] * 2, least=4)
    assert want
    assert found(C.collocations(rows, least=4)) == want
    assert C.collocations(odd.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        C.collocations(odd.empty(spark), least=300)
