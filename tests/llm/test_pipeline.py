from __future__ import annotations

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from fieldloom.llm import mixing, quality_rules
from fieldloom.llm.queries import TOKENIZERS
from fieldloom.llm.shared import table
from tests.compare import SMALL
from tests.llm import odd, test_mixing, test_near_dedup, test_pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage made of the small table, each written and read again."""
    place, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SMALL, "documents"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        out.append(docs)
    return [table(spark, SMALL, "documents"), *out]


def test_stages_in_order(steps):
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "near-dedup", "personal data", "mixing", "sentencepiece"]
    assert all(s.columns == COLUMNS for s in steps[:-1])


def test_quality_rejects_what_the_verdict_rejects(spark, steps):
    kept = {r.doc_id for r in quality_rules.quality_verdicts(steps[0], table(spark, SMALL, "labels")).where("kept").collect()}
    assert {r.doc_id for r in steps[1].collect()} == kept
    assert 0 < len(kept) < steps[0].count()


def test_one_of_each_group_stays(steps):
    rows = test_near_dedup.by_hand([(r.doc_id, r.text) for r in steps[1].collect()])
    kept = {eval(r)[0] for r in rows if eval(r)[3]}  # noqa: S307  our own tuples
    assert {r.doc_id for r in steps[2].collect()} == kept


def test_personal_data_is_replaced(steps):
    before = {r.doc_id: r.text for r in steps[2].collect()}
    assert {r.doc_id: r.text for r in steps[3].collect()} == {i: test_pii.by_hand_redacted(t) for i, t in before.items()}


def test_sources_reach_their_targets(spark, steps):
    weights = {r.doc_id: r.weight for r in mixing.quality_weights(table(spark, SMALL, "labels")).collect()}
    want = test_mixing.by_hand([(r.doc_id, r.text, r.source) for r in steps[3].collect()], weights)
    taken = {int(x.split()[0]): int(x.split()[-1]) for x in want}
    got = dict.fromkeys(taken, 0)
    for r in steps[4].collect():
        got[r.doc_id] += len(odd.words(r.text))
    assert got == taken


def test_ids_are_the_librarys_and_decode(steps):
    lib = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        ids = np.frombuffer(r.ids, np.int32).tolist()
        assert ids == lib.encode(texts[r.doc_id]) and r.parity and r.round_trip


def test_run_gives_the_last_stage(spark, steps):
    assert odd.sorted_rows(pipeline.run(spark, SMALL)) == odd.sorted_rows(steps[-1])


def test_odd_and_empty_documents(spark):
    for docs in (odd.documents(spark), odd.empty(spark)):
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == COLUMNS
        assert pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
