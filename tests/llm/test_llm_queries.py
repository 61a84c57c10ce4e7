from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from fieldloom.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import SMALL, same, views


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLE_SQL[name], views())


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_packed_tokens", "op6_importance_resampling", "op8_language_id", "op9_repeated_strings", "op10_sentencepiece", "op13_byte_bpe"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
