from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from fieldloom.llm import quality_rules as q
from fieldloom.llm.shared import table
from tests.compare import SMALL
from tests.llm import odd


def by_hand(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = odd.words(text)
    lines = [x for x in text.split("\n") if odd.words(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + j for i, g in enumerate(grams) if g in twice for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("where", ["odd", "table"])
def test_base_statistics_by_hand(spark, where):
    docs = odd.documents(spark) if where == "odd" else table(spark, SMALL, "documents")
    got = sorted(str((r.doc_id, *(r[c] for c in q.COUNTS), r.base_failed)) for r in q.quality_verdicts(docs, odd.labels(spark)).collect())
    want = []
    for r in docs.collect():
        n = by_hand(r.text)
        want.append(str((r.doc_id, *n, n[0] < 10 or 100 * n[4] > 20 * n[0])))
    assert got == sorted(want)


def test_without_labels_only_the_base_rules_reject(spark):
    assert all(r.kept != r.base_failed for r in q.quality_verdicts(odd.documents(spark), odd.labels(spark)).collect())
    nulls = odd.labels(spark, [(None, 1, 0), (5, None, 0), (6, 1, None), (6, 0, None)])
    assert all(r.kept != r.base_failed for r in q.quality_verdicts(odd.documents(spark), nulls).collect())


def test_empty_tables_and_clashing_columns(spark):
    assert q.quality_verdicts(odd.empty(spark), odd.labels(spark)).count() == 0
    assert q.keep_good(odd.empty(spark), odd.labels(spark)).count() == 0
    lab = odd.labels(spark, [(5, 1, 0), (9, 1, 0), (12, 0, 0), (11, 0, 0)])
    docs = odd.documents(spark)
    assert odd.sorted_rows(q.quality_verdicts(docs, lab)) == odd.sorted_rows(q.quality_verdicts(odd.crowded(docs), lab))
    assert q.keep_good(odd.crowded(docs), lab).columns == odd.crowded(docs).columns


def test_an_outlier_has_the_shortest_path():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (500, 3)), [[9.0, 9.0, 9.0]]])
    forest = q.IsolationForest.fit(rows, trees=50)
    assert forest.score(rows).argmax() == 500
    assert (forest.score(rows) == q.IsolationForest.fit(rows, trees=50).score(rows)).all()


def test_path_lengths_by_walking_the_trees():
    rows = np.random.default_rng(1).normal(0, 1, (64, 2))
    f = q.IsolationForest.fit(rows, trees=5)

    def walk(t: int, x: np.ndarray) -> float:
        node = 0
        while f.column[t, node] >= 0:
            node = 2 * node + 1 + int(x[f.column[t, node]] >= f.value[t, node])
        return f.path[t, node]

    want = [2.0 ** (-np.mean([walk(t, x) for t in range(5)]) / f.norm) for x in rows]
    np.testing.assert_allclose(f.score(rows), want, rtol=1e-12)


def test_threshold_spares_the_labelled_good_and_rejects_bad(spark):
    docs, lab = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = q.quality_verdicts(docs, lab).join(lab, "doc_id").select("quality", "kept", "base_failed").toPandas()
    good, bad = rows[(rows.quality == 1) & ~rows.base_failed], rows[rows.quality == 0]
    assert good.kept.mean() >= 0.99
    assert (~bad.kept).mean() >= 0.5


def test_the_stage_keeps_what_the_verdict_keeps(spark):
    docs, lab = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    kept = q.quality_verdicts(docs, lab).where("kept")
    assert sorted(r.doc_id for r in q.keep_good(docs, lab).collect()) == sorted(r.doc_id for r in kept.collect())


def test_held_out_labels(spark):
    """Fitted on even ids, judged on odd ones: bad documents go, and few good ones go beyond the base rules."""
    docs, lab = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = q.quality_verdicts(docs, lab.where("doc_id % 2 = 0")).join(lab.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept", "base_failed").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    print("held out: bad", len(bad), "rejected", int((~bad.kept).sum()), "good", len(good), "base", int(good.base_failed.sum()), "forest", int((~good.kept & ~good.base_failed).sum()))
    assert len(bad) > 100 and (~bad.kept).mean() >= 0.95
    assert (~good.kept & ~good.base_failed).mean() <= 0.01
