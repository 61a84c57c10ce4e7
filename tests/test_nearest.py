"""Nearest sensors by rings, and the recorder that lags, against loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import sensors, series
from fieldloom.plans import queries as Q
from fieldloom.sources import tables
from tests.compare import SMALL


def brute(n, si, sj):
    i, j = np.divmod(np.arange(n * n), n)
    return ((i[:, None] - np.array(si)) ** 2 + (j[:, None] - np.array(sj)) ** 2).argmin(1)


@pytest.mark.parametrize(("n", "k"), [(1, 1), (5, 1), (8, 9), (16, 3), (33, 200), (64, 100), (64, 4000)])
def test_rings_find_the_nearest_and_first(n, k):
    rng = np.random.default_rng(n * k)
    grids = [(rng.integers(0, n, k), rng.integers(0, n, k)) for _ in range(3)]
    grids.append((rng.integers(0, max(1, n // 4), k), rng.integers(0, max(1, n // 4), k)))  # all in a corner
    field = np.repeat(np.arange(4), k)
    got = sensors.nearest_sensor(n, field, np.concatenate([a for a, _ in grids]), np.concatenate([b for _, b in grids]), 4)
    for f, (si, sj) in enumerate(grids):
        assert (got[f] - f * k == brute(n, si, sj)).all()


def test_a_large_grid_and_ten_thousand_sensors():
    n, k = 512, 10_000
    rng = np.random.default_rng(1)
    si, sj = rng.integers(0, n, k), rng.integers(0, n, k)
    got = sensors.nearest_sensor(n, np.zeros(k, np.int64), si, sj, 1)[0]
    some = rng.integers(0, n * n, 3000)
    d2 = (some[:, None] // n - si) ** 2 + (some[:, None] % n - sj) ** 2
    assert (got[some] == d2.argmin(1)).all()


def test_join_and_batches_agree(spark):
    rng = np.random.default_rng(2)
    rows = []
    for t, k in enumerate([1, 4, 60]):
        rows.append((0, t, 20, [int(x) for x in rng.integers(0, 20, k)], [int(x) for x in rng.integers(0, 20, k)], [float(x) for x in range(k)]))
    rows.append((None, 9, 20, [3, 3, 17], [3, 3, 2], [1.0, 2.0, 3.0]))
    df = spark.createDataFrame(rows, "run int, t long, n int, si array<int>, sj array<int>, y array<double>")
    packed = {r.t: r.cell_sensor for r in sensors.tessellated(df).collect()}
    flat = df.where("run is not null").select("run", "t", F.posexplode(F.arrays_zip("si", "sj", "y")).alias("sid", "s")).select("run", "t", "sid", "s.si", "s.sj", "s.y")
    joined = {(r.t, r.i, r.j): (r.sid, r.v) for r in sensors.tessellated_cells(flat, 20).collect()}
    assert len(joined) == 3 * 400
    for _, t, n, si, sj, y in rows:
        want = brute(n, si, sj)
        assert packed[t] == want.tolist()
        if t < 9:
            assert [joined[t, i, j] for i in range(n) for j in range(n)] == [(w, y[w]) for w in want.tolist()]


def test_sensors_are_not_broadcast(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(sensors, "stored", kept)
    found = Q.QUERIES["voronoi_join"](spark, SMALL)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_no_sensors(spark):
    df = spark.createDataFrame([(0, 0, 2, [], [], [])], "run int, t long, n int, si array<int>, sj array<int>, y array<double>")
    assert sensors.tessellated(df).first().cell_sensor == [None] * 4


def recorded(times, step):
    kept, due = [], times[0]
    for at, t in enumerate(times):
        if t >= due:
            kept.append((at, t - due))
            due += step
    return kept


@pytest.mark.parametrize("name", ["events", "orders"])
def test_recorder_that_lags(spark, name):
    rows, step = (tables.series(spark, SMALL), Q.HOUR) if name == "events" else (Q.order_series(spark, SMALL), 24 * Q.HOUR)
    want = []
    by_run: dict = {}
    for r in rows.orderBy("run", "us", "id").collect():
        by_run.setdefault(r.run, []).append((r.us, r.v))
    for run, some in by_run.items():
        want += [(run, k, some[at][0], some[at][1], lag) for k, (at, lag) in enumerate(recorded([u for u, _ in some], step))]
    for bucket in (Q.HOUR, 10**15):
        assert sorted(map(tuple, series.cadence_with_lag(rows, step, bucket).collect())) == sorted(want)


def test_recorder_after_a_gap_and_without_times(spark):
    rows = [("a", t, i, float(i)) for i, t in enumerate([5, 6, 7, 40, 41, 42, 43, 44, 45])] + [("a", None, 99, 0.0), ("b", None, 1, 0.0), (None, 3, 1, 1.5), (None, 3, 2, 2.5)]
    df = spark.createDataFrame(rows, "run string, us long, id long, v double")
    got = sorted(((r.run or "", r.record, r.us, r.lag) for r in series.cadence_with_lag(df, 10, 7).collect()))
    assert got == [("", 0, 3, 0), ("a", 0, 5, 0), ("a", 1, 40, 25), ("a", 2, 41, 16), ("a", 3, 42, 7), ("a", 4, 45, 0)]
