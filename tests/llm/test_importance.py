from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from fieldloom.llm import importance as im
from fieldloom.llm.shared import table
from tests.compare import SMALL
from tests.llm import odd


def grams(text: str | None) -> list[tuple[str, ...]]:
    words = odd.words(odd.lower(text))
    return [(w,) for w in words] + list(zip(words, words[1:], strict=False))


def noise(doc_id: int | None, seed: int = 11) -> float:
    u = (int(hashlib.md5(f"{'' if doc_id is None else doc_id}|{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(-math.log(u))


def ids(spark, *chosen: int):
    return spark.createDataFrame([(i,) for i in chosen], "doc_id long")


def test_weights_by_hand_where_no_bucket_is_shared(spark):
    rows = [(1, "Good plain text and good words"), (2, "buy now buy now cheap"), (3, "good text"), (4, None), (5, "  ")]
    docs = odd.documents(spark, [(i, t, None, None) for i, t in rows])
    bits = 20
    raw, target = [g for _, t in rows for g in grams(t)], [g for i, t in rows if i in (1, 3) for g in grams(t)]
    log = lambda n, total: math.log(n + 1) - math.log(total + (1 << bits))
    ratio = {g: log(target.count(g), len(target)) - log(raw.count(g), len(raw)) for g in raw}
    got = {r.doc_id: r for r in im.log_weights(docs, im.fit_ratio(docs, ids(spark, 1, 3), bits)).collect()}
    for i, t in rows:
        assert got[i].n_grams == len(grams(t))
        assert got[i].log_weight == (pytest.approx(sum(ratio[g] for g in grams(t))) if grams(t) else None)
    assert got[3].log_weight > got[2].log_weight


def test_the_sample_is_the_top_by_noisy_score(spark):
    docs, lab = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    target, share = im.target_of(lab)
    rows = im.resample(docs, target, share).collect()
    scored = [r for r in rows if r.score is not None]
    for r in scored:
        assert r.score == pytest.approx(r.log_weight + noise(r.doc_id))
    order = sorted(scored, key=lambda r: (-r.score, r.doc_id))
    assert [r["rank"] for r in order] == list(range(1, len(order) + 1))
    k = round(share * len(scored))
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in order[:k]}
    assert len(rows) == docs.count()


def test_target_like_text_is_preferred(spark):
    rng = np.random.default_rng(0)
    vocabulary = ([f"good{i}" for i in range(50)], [f"junk{i}" for i in range(50)])
    docs = odd.documents(spark, [(i, " ".join(rng.choice(vocabulary[i % 2], 30)), "en", "a") for i in range(200)])
    got = im.resample(docs, ids(spark, *range(0, 40, 2)), 0.4).where("kept").collect()
    assert len(got) == 80 and sum(r.doc_id % 2 == 0 for r in got) > 75


def test_odd_rows(spark):
    docs = odd.documents(spark)
    rows = im.resample(docs, ids(spark, 5, 9), 0.5)
    got = rows.collect()
    assert len(got) == len(odd.TEXTS)
    assert all((r.score is None) == (not grams(dict_text(r.doc_id))) for r in got if r.doc_id not in (None, 13))
    assert not any(r.kept for r in got if r.score is None)
    assert odd.sorted_rows(rows) == odd.sorted_rows(im.resample(odd.crowded(docs), ids(spark, 5, 9), 0.5))
    assert im.resample(odd.empty(spark), ids(spark), 1.0).count() == 0
    assert {r.log_weight for r in im.resample(docs, ids(spark), 1.0).collect()} == {0.0, None}


def dict_text(doc_id: int) -> str | None:
    return {r[0]: r[1] for r in odd.TEXTS}[doc_id]


def test_target_of_labels(spark):
    lab = odd.labels(spark, [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, None, 0), (None, 1, 0), (5, 1, None), (6, 1, 0), (6, 0, 0)])
    target, share = im.target_of(lab)
    assert sorted(r.doc_id for r in target.collect()) == [1, 5] and share == pytest.approx(3 / 5)
    target, share = im.target_of(odd.labels(spark))
    assert target.count() == 0 and share == 1.0


def test_rows_without_ids_draw_by_their_texts(spark):
    rows = [(None, f"word{k} other{k % 7} thing" * 3, "en", "a") for k in range(300)]
    got = im.resample(odd.documents(spark, rows), odd.labels(spark).select("doc_id"), 0.5).collect()
    assert len({round(r.score - r.log_weight, 9) for r in got}) == 300 and sum(r.kept for r in got) == 150
