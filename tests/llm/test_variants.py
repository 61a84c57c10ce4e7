"""Spelling variants against brute force: every pair of words, and the hash by zlib."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import variants as V
from fieldloom.llm.queries import op11_spelling_variants
from fieldloom.llm.shared import table
from tests.compare import SMALL
from tests.llm import odd


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, shortest=5, least=3, times=2, delete_one_in=97) -> dict[str, tuple]:
    count: Counter = Counter()
    for name, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", odd.lower(text)):
            h = zlib.crc32(f"{'' if name is None else name}:{word}".encode())
            if delete_one_in and h % delete_one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    words = {w: n for w, n in count.items() if len(w) >= shortest and n >= least}
    by_mask: dict[tuple, list[str]] = {}
    for w in words:
        for key in {(w[:i], w[i + 1 :]) for i in range(len(w))} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}:
            by_mask.setdefault(key, []).append(w)
    partners = {w: set() for w in words}
    for some in by_mask.values():
        for a in some:
            partners[a].update(b for b in some if b not in partners[a] and near(a, b))
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(partners[w]), words[form[w]] if form[w] else None)
    return out


def found(df) -> dict[str, tuple]:
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text(alphabet="abéÿ", min_size=1, max_size=7), min_size=1, max_size=60))
def test_trie_meets_every_word_at_distance_one_once(words):
    ordered = sorted(words)
    trie = V.Trie.read(*V.Trie.of(ordered, [1] * len(ordered)).arrays())
    data = [w.encode("latin-1") for w in ordered]
    size = np.array(list(map(len, data)))
    q, other = trie.near(np.frombuffer(b"".join(data) + b"\0", np.uint8), np.cumsum(size) - size, size)
    assert sorted((ordered[a], trie.spelled(b)) for a, b in zip(q, other, strict=True)) == sorted((a, b) for a in words for b in words if a != b and near(a, b))


@pytest.mark.parametrize("bounds", [{}, {"shard_words": 300, "group_bytes": 1 << 15}])
def test_whole_table_against_brute_force(spark, bounds):
    documents = table(spark, SMALL, "documents")
    want = brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert len(want) > 1000
    assert found(V.variants(documents, delete_one_in=97, **bounds) if bounds else op11_spelling_variants(spark, SMALL)) == want


def test_chains_ties_and_long_runs(spark):
    long = "y" * 3000
    text = " ".join(["Kitten"] * 40 + ["kittén"] * 12 + ["kittéén"] * 4 + ["mitten"] * 40 + ["fitten"] * 3 + ["alone"] * 3 + [long] * 8 + [long + "y"] * 3)
    rows = [(1, text), (2, None), (3, ""), (None, "kitten " * 5), (1, text), (4, "ÀÉÎÕÜ " * 3 + "àÉÎÕÜ " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, delete_one_in=0)
    assert want["fitten"][0] == "kitten" and want["kittéén"][:2] == ("kittén", "kitten") and want[long + "y"][0] == long
    assert found(V.variants(df)) == want
    assert found(V.variants(df, shortest=2, least=1, times=3, delete_one_in=2)) == brute(rows, 2, 1, 3, 2)


def test_odd_rows(spark):
    want = brute([(i, t) for i, t, _, _ in odd.TEXTS])
    assert found(V.variants(odd.crowded(odd.documents(spark)), delete_one_in=97)) == want
    assert V.variants(odd.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        V.variants(odd.empty(spark), times=1)
