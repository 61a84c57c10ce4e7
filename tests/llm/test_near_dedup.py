from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from fieldloom.llm import near_dedup as nd
from fieldloom.llm.shared import table
from tests.compare import SMALL
from tests.llm import odd


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = odd.words(odd.lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(rows: list[tuple[int | None, str | None]]) -> list[str]:
    sets = [(i, shingles(t)) for i, t in rows]
    up: dict[int, int] = {i: i for i, _ in rows if i is not None}

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    real = [(i, s) for i, s in sets if i is not None and s]
    for (i, s), (j, t) in itertools.combinations(real, 2):
        if 100 * len(s & t) >= 75 * len(s | t):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return sorted(str((i, len(s), None if i is None else find(i), True if i is None else find(i) == i)) for i, s in sets)


def shown(df) -> list[str]:
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in df.collect())


def test_odd_rows_by_hand(spark):
    docs = odd.documents(spark)
    want = by_hand([(r[0], r[1]) for r in odd.TEXTS])
    assert shown(nd.near_duplicates(docs)) == want
    assert shown(nd.near_duplicates(odd.crowded(docs))) == want


@pytest.mark.parametrize("block", [8, 512])
def test_chains_of_copies_by_hand(spark, block):
    """Copies with more and more changed words; similarities lie on both sides of the threshold."""
    rng, rows, n = random.Random(4), [], 0
    for _ in range(12):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 20, 60, 200]))]
        for _ in range(12):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                text[rng.randrange(len(text))] = f"w{rng.randrange(5000)}"
    rng.shuffle(rows)
    docs = odd.documents(spark, [(i, t, None, None) for i, t in rows])
    assert shown(nd.near_duplicates(docs, block=block)) == by_hand(rows)


def test_the_table_by_hand(spark):
    docs = table(spark, SMALL, "documents")
    assert shown(nd.near_duplicates(docs)) == by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table_and_the_stage(spark):
    assert nd.near_duplicates(odd.empty(spark)).count() == 0
    docs = odd.crowded(odd.documents(spark))
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    # Id 13 has two texts, one like that of 4 and one like that of 5, 6 and 7, which makes one class of all.
    assert {4, 5, 6, 7, 9, 13} - {r.doc_id for r in kept.collect()} == {5, 6, 7, 13}


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 1000 + i) for i in range(300)] + [(5, 5)]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[1000 + i] == 7 for i in range(300))
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_posterior_bounds():
    """A pair goes only if so few matches make the threshold less probable than the chosen miss."""
    for n, least in zip(range(nd.BATCH, 129, nd.BATCH), nd.least_matches(128, 0.75, 1e-6), strict=True):
        m = least - 1
        grid = (np.arange(200_000) + 0.5) / 200_000
        logs = math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid)
        assert np.exp(logs[grid >= 0.75]).sum() / len(grid) < 1e-6


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 1500, dtype=np.uint64))
    b = np.concatenate([a[:1000], rng.integers(0, 2**63, 300, dtype=np.uint64)])
    same = (nd.signature(a, 1024) == nd.signature(np.sort(b), 1024)).mean()
    assert same == pytest.approx(1000 / (len(a) + 300), abs=0.06)


def test_the_same_by_shuffles(spark, monkeypatch):
    """Beyond a million ids their joins shuffle; nothing is broadcast here."""
    monkeypatch.setattr(nd, "small", lambda stored: stored)
    docs = odd.documents(spark)
    assert shown(nd.near_duplicates(docs)) == by_hand([(r[0], r[1]) for r in odd.TEXTS])
    assert {4, 5, 6, 7, 9, 13} - {r.doc_id for r in nd.keep_one(docs).collect()} == {5, 6, 7, 13}
