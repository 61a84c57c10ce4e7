"""Analyses as folds over columns, against dense solutions in numpy and the minimiser."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import analysis, assimilation, covariance
from fieldloom.plans import queries as Q
from tests.compare import SMALL

N, STD = 6, 0.05


def dense(spectrum: np.ndarray) -> np.ndarray:
    """The matrix of a stationary covariance, with its least value added."""
    k = np.fft.ifft2(spectrum + analysis.EPS * spectrum.max()).real
    i, j = np.divmod(np.arange(spectrum.size), len(spectrum))
    return k[(i[:, None] - i) % len(spectrum), (j[:, None] - j) % len(spectrum)]


def problem(spark, count: int = 5, m: int = 7):
    rng = np.random.default_rng(11)
    rows = [(k, N, rng.standard_normal(N * N).tolist(), rng.standard_normal(N * N).tolist(), rng.integers(0, N, m).tolist(), rng.integers(0, N, m).tolist(), rng.standard_normal(m).tolist()) for k in range(count)]
    return rows, spark.createDataFrame(rows, "t int, n int, x_b array<double>, x_v array<double>, si array<int>, sj array<int>, y array<double>")


def cost_of(x, terms, h, y):
    return sum(0.5 * (x - c) @ np.linalg.solve(m, x - c) for c, m in terms) + 0.5 * ((y - x[h]) ** 2).sum() / (STD**2 + 1e-12)


def test_two_terms(spark):
    s = covariance.correlation_spectrum(N, 2.0) * 0.3**2
    b = dense(s)
    rows, df = problem(spark)
    found = {r.t: r for r in analysis.analysed(df, analysis.kernels(spark, {N: s}), STD).collect()}
    minimised = {r.t: r.x_da_cost[-1] for r in assimilation.analysed(df, 2.0, 0.3, STD, rounds=2000).collect()}
    for t, _, x_b, _, si, sj, y in rows:
        h, x_b, y = np.array(si) * N + np.array(sj), np.array(x_b), np.array(y)
        w = np.linalg.solve(b[np.ix_(h, h)] + (STD**2 + 1e-12) * np.eye(len(h)), y - x_b[h])
        x = x_b + b[:, h] @ w
        np.testing.assert_allclose(found[t].x_a, x, atol=1e-7)
        np.testing.assert_allclose(found[t].x_a_w, w, atol=1e-4)
        assert found[t].x_a_cost[0] == pytest.approx(cost_of(x_b, [(x_b, b)], h, y))
        assert found[t].x_a_cost[-1] == pytest.approx(0.5 * (y - x_b[h]) @ w, rel=1e-8)
        assert len(found[t].x_a_cost) <= 2 * len(h) + 1
        # The minimiser stops where its cost hardly falls: near, and never below.
        assert found[t].x_a_cost[-1] <= minimised[t] * (1 + 1e-9) <= found[t].x_a_cost[-1] * 1.01


def test_three_terms(spark):
    s, p = covariance.correlation_spectrum(N, 2.0) * 0.3**2, covariance.correlation_spectrum(N, 1.0) * 0.2**2
    rows, df = problem(spark)
    met = analysis.between(df, s, p)
    found = {r.t: r for r in analysis.analysed(met, analysis.kernels(spark, {N: analysis.combined(s, p)}), STD, "x_m").collect()}
    bi, pi = np.linalg.inv(dense(s)), np.linalg.inv(dense(p))
    for t, _, x_b, x_v, si, sj, y in rows:
        h = np.zeros((len(y), N * N))
        h[np.arange(len(y)), np.array(si) * N + np.array(sj)] = 1
        r = 1 / (STD**2 + 1e-12)
        want = np.linalg.solve(bi + pi + r * h.T @ h, bi @ x_b + pi @ x_v + r * h.T @ np.array(y))
        np.testing.assert_allclose(found[t].x_a, want, atol=1e-6)


def test_odd_rows(spark):
    s = covariance.correlation_spectrum(N, 2.0)
    field = [1.0] * (N * N)
    rows = [
        (0, N, None, [1], [1], [1.0]),
        (1, N, field, [], [], []),
        (2, N, field, [1], [1], None),
        (3, N, field, [1, 2], [1, 2], [float("nan"), 1.0]),
        (4, 99, field, [1], [1], [1.0]),
        (5, N, field, [1, 1], [1, 1], [2.0, 4.0]),  # two sensors of one cell
        (6, N, field, [1], [1], [1.0]),  # nothing to correct
    ]
    df = spark.createDataFrame(rows, "t int, n int, x_b array<double>, si array<int>, sj array<int>, y array<double>")
    got = {r.t: r for r in analysis.analysed(df, analysis.kernels(spark, {N: s}), STD).collect()}
    assert len(got) == 7 and all(got[t].x_a is None for t in range(5))
    assert got[5].x_a[N + 1] == pytest.approx(1 + 2 / (1 + STD**2 / 2), abs=1e-3)
    assert got[6].x_a == field and got[6].x_a_cost == [0.0]
    assert analysis.analysed(df.where("false"), analysis.kernels(spark, {N: s}), STD).count() == 0


def test_every_snapshot(spark):
    found = Q.two_terms(spark, SMALL)
    assert found.where("x_a is null").isEmpty()
    history = Q.QUERIES["analysis_cost_history"](spark, SMALL)
    ends = history.groupBy("run", "t").agg(F.max_by("cost", "step").alias("last"), F.min_by("cost", "step").alias("first"))
    assert ends.where("last > first").isEmpty() and ends.count() == found.count()


def test_rows_minimised_together_are_as_alone():
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.standard_normal((6, 20, 20)))[0]
    a = q @ (np.array([1, 1, 10, 1e3, 1e6, 1])[:, None, None] ** np.linspace(0, 1, 20)[None, :, None] * q.swapaxes(1, 2))
    b = rng.standard_normal((6, 20))
    b[0], b[5] = 0, np.nan  # at its minimum from the start, and never anywhere

    def some(x, rows):
        ax = (a[rows] @ x[..., None])[..., 0]
        return 0.5 * (x * ax).sum(1) - (b[rows] * x).sum(1), ax - b[rows]

    x, iterations, costs = assimilation.minimised(some, np.zeros((6, 20)), 60, memory=4)
    assert iterations[0] == 0 and len(set(iterations.tolist())) >= 4 and np.isnan(x[5]).all()
    np.testing.assert_allclose(x[:3], np.linalg.solve(a[:3], b[:3, :, None])[..., 0], atol=1e-3)
    for k in range(6):
        alone = assimilation.minimise(lambda z, k=k: tuple(v[0] for v in some(z[None], [k])), np.zeros(20), 60, memory=4)
        np.testing.assert_array_equal(alone[0], x[k])
        assert alone[1] == iterations[k] and str(alone[2]) == str(costs[k])


def test_sides_and_numbers_of_sensors_differ_in_a_batch(spark):
    rng = np.random.default_rng(9)
    kinds = [(6, 7), (4, 3), (6, 2), (6, 0), (6, 7)]
    rows = [(k, n, rng.standard_normal(n * n).tolist(), rng.integers(0, n, m).tolist(), rng.integers(0, n, m).tolist(), rng.standard_normal(m).tolist()) for k, (n, m) in enumerate(kinds)]
    df = spark.createDataFrame(rows, "t int, n int, x_b array<double>, si array<int>, sj array<int>, y array<double>").coalesce(1)
    found = assimilation.analysed(df, 1.0, 0.3, STD).collect()
    assert [r.t for r in found] == [0, 1, 2, 3, 4] and found[3].x_da == rows[3][2]
    for r in found:
        assert assimilation.analysed(df.where(F.col("t") == r.t), 1.0, 0.3, STD).collect() == [r]


def test_snapshots_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(Q, "ANALYSED", 20)
    rows = Q.problems(spark, SMALL)
    assert rows.rdd.getNumPartitions() == 1 + rows.count() // 20 > 3
