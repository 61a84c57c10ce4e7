from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pytest

from fieldloom.llm import mixing
from fieldloom.llm.shared import table
from tests.compare import SMALL
from tests.llm import odd


def goals(sizes: dict, rates=(3, 1, 2), percent=150, most=2) -> dict:
    """Targets by refilling until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    rate = {s: rates[i % len(rates)] for i, s in enumerate(names)}
    budget, capped = sum(sizes.values()) * percent / 100, set()
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(most * sizes[s] for s in capped)
        level = left / sum(rate[s] for s in free) if free else 0
        over = [s for s in free if level * rate[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else level * rate[s] for s in names}
        capped.update(over)


def by_hand(rows: list[tuple], weights: dict) -> list[str]:
    sizes, own = defaultdict(int), defaultdict(list)
    for doc_id, text, source in rows:
        n = len(odd.words(text))
        sizes[source] += n
        name = hashlib.md5((text or "").encode()).hexdigest() if doc_id is None else doc_id
        u = (int(hashlib.md5(f"{name}|17".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        own[source].append((-math.log(u) / weights.get(doc_id, 1.0), -1 if doc_id is None else doc_id, n, doc_id))
    goal, out = goals(sizes), []
    for source, docs in own.items():
        epochs = int(goal[source] // sizes[source]) if sizes[source] else 0
        rest, before = goal[source] - epochs * sizes[source], 0
        for _, _, n, doc_id in sorted(docs, key=lambda x: x[:3]):
            extra = 2 * before + n <= 2 * rest and rest > 0
            before += n
            out.append(f"{doc_id} {n} {sizes[source]} {goal[source]:.6f} {n * (epochs + extra)}")
    return sorted(out)


def shown(df) -> list[str]:
    return sorted(f"{r.doc_id} {r['size']} {r.source_size} {r.target:.6f} {r.taken}" for r in df.collect())


@pytest.mark.parametrize("where", ["odd", "table"])
def test_by_hand(spark, where):
    docs = odd.documents(spark) if where == "odd" else table(spark, SMALL, "documents")
    lab = odd.labels(spark, [(5, 1, 0), (6, 0, 1), (None, 1, 0), (9, None, 0)]) if where == "odd" else table(spark, SMALL, "labels")
    weights = {r.doc_id: r.weight for r in mixing.quality_weights(lab).collect()}
    assert shown(mixing.mix(docs, lab)) == by_hand([(r.doc_id, r.text, r.source) for r in docs.collect()], weights)


def test_bounds_targets_and_reruns(spark):
    docs, lab = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    rows = mixing.mix(docs, lab).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all()
    source = docs.select("doc_id", "source").toPandas().set_index("doc_id").source
    rows["source"] = rows.doc_id.map(source)
    for _, own in rows.groupby("source", dropna=False):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    assert shown(mixing.mix(docs.repartition(7), lab)) == shown(mixing.mix(docs, lab))


def test_a_better_weight_is_taken_more_often(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(600)] + [(1000 + i, "w " * 10, "en", "b") for i in range(600)]
    lab = odd.labels(spark, [(i % 600 + 1000 * (i >= 600), i % 2, 0) for i in range(1200)])
    got = mixing.mix(odd.documents(spark, rows), lab, percent=50).toPandas()
    taken = got[got.taken > 0].doc_id % 2
    assert taken.mean() > 0.6


def test_the_stage_repeats_rows_as_the_mix_takes_them(spark):
    docs, lab = odd.documents(spark), odd.labels(spark, [(5, 1, 0)])
    copies = mixing.mixed_rows(odd.crowded(docs), lab)
    assert copies.columns == odd.crowded(docs).columns
    taken = sum(r.taken for r in mixing.mix(docs, lab).collect())
    assert sum(len(odd.words(r.text)) for r in copies.collect()) == taken
    assert shown(mixing.mix(odd.crowded(docs), lab)) == shown(mixing.mix(docs, lab))


def test_empty_table(spark):
    assert mixing.mix(odd.empty(spark), odd.labels(spark)).count() == 0
    assert mixing.mixed_rows(odd.empty(spark), odd.labels(spark)).count() == 0


def test_the_same_by_shuffles(spark, monkeypatch):
    """Beyond a million weights their join shuffles."""
    docs, lab = odd.documents(spark), odd.labels(spark, [(5, 1, 0), (6, 0, 1)])
    want, rows = shown(mixing.mix(docs, lab)), odd.sorted_rows(mixing.mixed_rows(docs, lab))
    monkeypatch.setattr(mixing, "small", lambda stored: stored)
    assert shown(mixing.mix(docs, lab)) == want and odd.sorted_rows(mixing.mixed_rows(docs, lab)) == rows
