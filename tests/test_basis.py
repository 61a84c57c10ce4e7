"""Modes of a stack against numpy's singular value decomposition."""

from __future__ import annotations

import numpy as np
import pytest

from fieldloom.operators import basis as B
from fieldloom.sources import tables
from tests.compare import SMALL


def stack(spark, x: np.ndarray):
    n = int(np.sqrt(x.shape[1]))
    return spark.createDataFrame([(0, t, n, row.tolist()) for t, row in enumerate(x)], "run int, t long, n int, field array<double>").repartition(3)


def vectors(found: B.Basis) -> np.ndarray:
    out = np.zeros((found.cells, found.columns.count))
    for r in found.rows().collect():
        out[r.cell, r.mode - 1] = r.value
    return out


def held(spark, x: np.ndarray, modes: int, **options) -> B.Basis:
    df = stack(spark, x)
    found = B.leading(df, modes, **options)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    modes = min(modes, int((s > 1e-6 * s[0]).sum()))
    np.testing.assert_allclose(found.singular, s[:modes], rtol=1e-7)
    got, want = vectors(found), v[:modes].T
    np.testing.assert_allclose(got.T @ got, np.eye(modes), atol=1e-9)
    np.testing.assert_allclose(np.abs((got * want).sum(0)), 1, atol=1e-6)
    assert (got[np.abs(got).argmax(0), np.arange(modes)] > 0).all()
    energy = [r.energy for r in found.energy(df).orderBy("mode").collect()]
    np.testing.assert_allclose(energy, np.cumsum(s[:modes] ** 2) / (s**2).sum(), rtol=1e-9)
    back = np.zeros_like(x)
    for r in B.restored(df, found).collect():
        back[r.t, r.cell] = r.v
    np.testing.assert_allclose(back, x @ want @ want.T, atol=1e-6 * s[0])
    return found


def decaying(rows: int, cells: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((rows, cells)) @ (rng.standard_normal((cells, cells)) * 0.7 ** np.arange(cells)[:, None])


def test_one_block(spark):
    held(spark, decaying(60, 36), 5, more=3)


def test_several_blocks_meet_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 16)  # read on the driver and shipped with the functions' closures
    held(spark, decaying(40, 49, 2), 4, more=3)


def test_few_fields_and_low_rank(spark):
    rng = np.random.default_rng(4)
    held(spark, rng.standard_normal((3, 25)), 6)
    held(spark, rng.standard_normal((30, 2)) @ rng.standard_normal((2, 16)), 5)


def test_the_table_of_fields(spark):
    x = np.array([r.field for r in tables.fields(spark, SMALL).collect()])
    found = B.leading(tables.fields(spark, SMALL), 8)
    np.testing.assert_allclose(found.singular, np.linalg.svd(x, compute_uv=False)[:8], rtol=1e-8)


def test_empty_and_unequal(spark):
    empty = stack(spark, np.zeros((1, 4))).where("false")
    assert B.leading(empty, 3).columns.count == 0
    with pytest.raises(ValueError):
        B.leading(stack(spark, np.ones((1, 4))).union(stack(spark, np.ones((1, 9)))), 2)


def test_rows_of_one_block_do_not_carry_the_columns(spark):
    df = stack(spark, decaying(20, 16))
    found = B.leading(df, 4)
    for rows in (B.restored(df, found), B.reduced(df, found)):
        assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
