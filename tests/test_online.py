"""Online resampling against the whole table's, over micro-batches of any size."""

from __future__ import annotations

import numpy as np
import pytest

from fieldloom.operators import series
from fieldloom.streaming import online

STEP = 10_000_000


def ran(spark, tmp_path, parts, idle="365 days"):
    """Ticks and late samples of parts that come one after the other."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "run string, us long, id long, v double"
    for part in parts:
        spark.createDataFrame(part, kind).write.mode("append").parquet(str(tmp_path / "in"))
        found = online.resampled(own.readStream.schema(kind).parquet(str(tmp_path / "in")), STEP, idle).writeStream.format("parquet")
        found.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(online.OUT).parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("cut", [1, 3, 50])
def test_ticks_are_those_of_the_whole(cut):
    rng = np.random.default_rng(cut)
    us = np.sort(np.append(rng.integers(-300, 900, 80), [500] * 4)) * 1_000_000
    v = rng.standard_normal(len(us))
    want, got, before = online.ticks_between(us, v, None, STEP), [], None
    for a in range(0, len(us), cut):
        got.append(online.ticks_between(us[a : a + cut], v[a : a + cut], before, STEP))
        before = (us[min(len(us), a + cut) - 1], v[min(len(us), a + cut) - 1])
    assert (np.concatenate([x[0] for x in got]) == want[0]).all() and len(want[0]) > 80
    assert np.concatenate([x[1] for x in got]) == pytest.approx(want[1], abs=1e-12)


def test_batches_of_runs(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = sorted(((run, int(us + 1) * 1_000_000, k, float(rng.standard_normal())) for run in ("a", "b", None) for k, us in enumerate(rng.permutation(900)[:90])), key=lambda r: r[1:3])
    parts = [rows[k : k + 90] for k in range(0, 270, 90)]
    for p in parts:
        rng.shuffle(p)
    late = [("a", 1_000_000, -1, 7.0), (None, 1_000_001, 501, 8.0)]
    nothing = [("a", None, 1, 1.0), ("b", 10**12, None, 1.0), ("a", 10**12, 2, None), ("a", -5, 2, 1.0)]
    found = ran(spark, tmp_path, [[(str(r) if r is not None else None, int(u), int(i), float(v)) for r, u, i, v in p] for p in parts[:2]] + [late + nothing] + [[tuple(r) for r in parts[2]]])
    key = lambda df: {(r.run, r.us): round(r.v, 9) for r in df.collect()}
    ticks = found.where("not late")
    assert key(ticks) == key(series.resampled(spark.createDataFrame(rows, "run string, us long, id long, v double"), STEP)) and ticks.count() == len(key(ticks))
    assert sorted(map(str, ((r.run, r.us, r.id, r.v) for r in found.where("late").collect()))) == sorted(map(str, late))


def test_a_silent_run_loses_its_state(spark, tmp_path):
    second, hour = 1_000_000, 3_600_000_000
    parts = [[("a", 10 * second, 0, 1.0)], [("b", 10 * hour, 1, 1.0)], [("b", 10 * hour + second, 2, 1.0)], [("a", 10 * hour, 3, 5.0)]]
    found = ran(spark, tmp_path, parts, "1 hour").where("run = 'a'")
    assert [(r.us, r.v, r.late) for r in found.orderBy("us").collect()] == [(10 * second, 1.0, False), (10 * hour, 5.0, False)]  # no ticks between
