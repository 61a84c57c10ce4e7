from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows: list[tuple[int, list[float]]], every: int, k: int) -> list[str]:
    dim, out = max((len(v) for _, v in rows), default=0), []
    m = np.zeros((len(rows), dim))
    for i, (_, v) in enumerate(rows):
        m[i, : len(v)] = np.floor(np.array(v, dtype=np.float32).astype(np.float64) * 256)
    for i, (own, _) in enumerate(rows):
        if own % every == 0:
            found = sorted((-int(s), n) for s, (n, _) in zip(m @ m[i], rows, strict=True) if n != own)[:k]
            out += [str((own, r + 1, n, -s)) for r, (s, n) in enumerate(found)]
    return sorted(out)


def run(df, every: int, k: int) -> list[str]:
    rows = topk.usable(df).withColumn("weights", topk.quantized(256.0))
    got = topk.top_k(rows.where(F.col("vec_id") % every == 0), rows, k)
    return sorted(str((r.query_id, r["rank"], r.vec_id, r.score)) for r in got.collect())


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_against_every_pair(spark, spread):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(0, spread, (700, 12)), 2)
    vectors[100:140] = vectors[7]  # ties
    rows = [(int(i), [float(x) for x in v], None) for i, v in enumerate(vectors)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5), 10, 5) == by_hand([r[:2] for r in rows], 10, 5)


def test_what_takes_no_part(spark):
    good = [(0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [], 0), (3, [-1.0, 0.5, 2.0], None)]
    bad = [(None, [1.0], 1), (10, None, 1), (20, [1.0, None], 1), (30, [float("nan")], 1), (40, [float("inf"), 1.0], 1), (50, [float("-inf")], 1)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    want = by_hand([r[:2] for r in good], 1, 5)
    assert run(df, 1, 5) == want
    assert run(df.select("*", *[F.lit(None).cast("int").alias(c) for c in ("weights", "shard", "part", "name", "rank")]), 1, 5) == want


def test_empty_and_single(spark):
    assert run(spark.createDataFrame([], SCHEMA), 1, 5) == []
    assert run(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), 1, 5) == []
    twice = spark.createDataFrame([(0, [1.0], 1), (0, [1.0], 1), (1, [2.0], 1)], SCHEMA)
    assert run(twice, 50, 5) == [str((0, 1, 1, 256 * 512))] * 2


def test_blocks_are_pruned_and_ties_at_the_bound_are_not():
    ids = [np.array([5, 6]), np.array([1, 2]), np.array([3, 4])]
    blocks = [np.array([[3.0], [3.0]]), np.array([[3.0], [1.0]]), np.array([[0.0], [0.0]])]
    scores, names, seen = topk.best_in_blocks(np.array([1.0]), -1, np.array([3.0, 3.0, 0.0]), ids, blocks, 2)
    assert names.tolist() == [1, 5] and scores.tolist() == [3, 3] and seen < 4
    _, _, seen = topk.best_in_blocks(np.array([1.0]), -1, np.array([9.0] + [0.0] * 50), [np.array([i]) for i in range(51)], [np.array([[9.0 * (i == 0)]]) for i in range(51)], 1)
    assert seen == 1


def test_blocks_of_similar_vectors_are_pruned(spark):
    """Vectors around 40 directions, in no order of their ids: most blocks stay unscored, and the result is that of all pairs."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (40, 16))
    vectors = np.round(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.02, (6000, 16)), 3)
    rows = [(int(i), [float(x) for x in v], None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = topk.usable(df).withColumn("weights", topk.quantized(256.0))
    r = topk.cells(found.where("vec_id % 50 = 0"), found, 5).groupBy("query_row").agg(F.first("blocks").alias("all"), F.first("scored").alias("scored")).agg(F.sum("scored") / F.sum("all")).first()[0]
    assert r < 0.25
    assert run(df, 50, 5) == by_hand([r[:2] for r in rows], 50, 5)


def test_huge_weights_are_no_failure(spark):
    df = spark.createDataFrame([(0, [3e38, 1.0], 1), (1, [3e38, 0.0], 1), (2, [-3e38, 0.0], 1)], SCHEMA)
    assert run(df, 50, 5) == [str((0, 1, 1, 2**63 - 1)), str((0, 2, 2, -(2**63)))]
