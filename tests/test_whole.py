"""Operators over whole runs, against brute force."""

from __future__ import annotations

import os

import numpy as np
import pytest

from fieldloom.operators import ensemble, metrics, selection, series
from fieldloom.plans import queries
from fieldloom.plans.queries import QUERIES
from fieldloom.sources import stores, tables
from fieldloom.streaming import series as stream_series
from tests.compare import SMALL


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_every_step_is_controlled(spark, block):
    rng = np.random.default_rng(block)
    errors = {"a": rng.uniform(0.02, 0.14, 90), "b": rng.uniform(0.11, 0.2, 9), None: rng.uniform(0.02, 0.14, 30)}
    rows = [(run, k, float(r)) for run, rs in errors.items() for k, r in enumerate(rs)]
    got = {(r.run, r.position): r.dt for r in series.step_sizes(spark.createDataFrame(rows, "run string, position long, r double").repartition(3), 1e-5, 0.1, block).collect()}
    want = {}
    for run, rs in errors.items():
        before, dt = 0.08, 1e-5
        for k, r in enumerate(rs):
            if r > 0.1:
                dt *= 0.75
            else:
                dt, before = (0.075 / r) ** 0.075 * (before / r) ** 0.1 * dt, r
            want[run, k] = dt
    assert got == pytest.approx(want, rel=1e-9)


def test_no_step_is_missing(spark):
    assert QUERIES["step_controller"](spark, SMALL).count() == tables.fields(spark, SMALL).count()


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_every_name_is_numbered(spark, width):
    names = [f"snapshot_{k}.parquet" for k in np.random.default_rng(width).permutation(60)] + ["other_7.txt", "readme", "notes.md", "x_007"]
    got = {r.file_name: (r.suffix, r.position) for r in tables.by_suffix(spark.createDataFrame([(x,) for x in names], "file_name string").repartition(3), width=width).collect()}
    suffix = lambda x: int(t) if (t := x.split(".")[0].split("_")[-1]).isdigit() else None
    ordered = sorted(names, key=lambda x: (-1 if suffix(x) is None else suffix(x), x))
    assert got == {x: (suffix(x), k) for k, x in enumerate(ordered)}


def test_no_name_or_position_is_missing(spark):
    t = sorted(r.t for r in tables.fields(spark, SMALL).select("t").collect())
    assert sorted(r.suffix for r in QUERIES["files_by_suffix"](spark, SMALL).collect()) == t
    assert sorted(r.position for r in QUERIES["run_lookup"](spark, SMALL).collect()) == list(range(len(t)))


@pytest.mark.parametrize("name", ["da_3dvar", "da_3dvar_nonlinear", "da_three_term", "cost_history", "da_reduced"])
def test_every_snapshot_of_the_test_run_is_analysed(spark, name):
    runs = [(r.run, r.t) for r in tables.fields(spark, SMALL).select("run", "t").collect()]
    want = sorted((run, t) for run, t in runs if run == max(runs)[0])
    found = QUERIES[name](spark, SMALL).select("run", "t")
    found = found.distinct() if name == "cost_history" else found
    assert len(want) > 20 and sorted((r.run, r.t) for r in found.collect()) == want


def test_runs_are_with_or_without_times(spark):
    with_, without = ({r.run for r in QUERIES[f"runs_{k}_times"](spark, SMALL).collect()} for k in ("with", "without"))
    assert with_ == {0, 1, 2, 3, 4} and without == {5, 6, 7, 8, 9}


@pytest.mark.parametrize("tile", [1, 2, 5, 16])
def test_every_lag_against_numpy(spark, tile):
    rng = np.random.default_rng(tile)
    xs = {1: rng.standard_normal(45) + 1j * rng.standard_normal(45), None: rng.standard_normal(8) + 3, 3: np.array([2.0])}
    rows = [(run, k, float(z.real), float(z.imag)) for run, x in xs.items() for k, z in enumerate(x)]
    df = spark.createDataFrame(rows, "run int, pos long, re double, im double").repartition(3)
    got = {(r.run, r.lag): r.acf for r in series.full_autocorrelation(df, ["run"], tile).collect()}
    want = {}
    for run, x in xs.items():
        c = x - x.mean()
        want |= {(run, k): float((c[k:] @ c[:-k].conj()).real / (c @ c.conj()).real) for k in range(1, len(x))}
    assert got == pytest.approx(want, abs=1e-12)


def test_stream_takes_rows_out_of_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    second = 1_000_000
    rows = [(run, int(us) * second, k, float(rng.standard_normal())) for run in ("a", None) for k, us in enumerate(rng.permutation(np.append(rng.integers(0, 900, 80), [500] * 4)))]
    kind = "run string, us long, id long, v double"
    parts = [rows[k::4] for k in range(4)] + [[("end", 10**12 * second, 0, 0.0)]]
    for k, part in enumerate(parts):  # a file for each batch; the last lets the watermark pass all others
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
        for f in (tmp_path / f"in/part={k}").iterdir():
            os.utime(f, (10**9 + k, 10**9 + k))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    closed = stream_series.closed(stream, 10 * second, "1 hour", 3)
    started = closed.writeStream.format("memory").queryName("closed_buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
    started.trigger(availableNow=True).start().awaitTermination()
    one = lambda df: sorted(map(str, df.collect()))
    want = one(series.resampled(spark.createDataFrame(rows, kind), 10 * second))
    assert len(want) > 150 and one(stream_series.resampled(spark.table("closed_buckets"), 10 * second)) == want


def test_a_run_cut_by_its_steps_says_so(spark):
    m = spark.createDataFrame([("a", 8, 0.1)], "run string, n int, tau0 double")
    whole, cut = (ensemble.simulated(m, 0.2, 0.05, 4, nu=1e-12, most_steps=k).collect() for k in (5000, 3))
    assert [r.status for r in whole] == [None] * 4
    assert [(r.run, r.t, r.time, r.field, r.status) for r in cut] == [("a", 0, None, None, "steps")]


# --- Queries that SQL can't express, against numpy over the whole table ------------------


def matrix(rows, column: str) -> np.ndarray:
    return np.array([r[column] for r in rows])


def rrmse(x: np.ndarray, truth: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x - truth, axis=1) / np.linalg.norm(truth, axis=1)


def test_pod_energy_against_svd(spark):
    x = matrix(tables.fields(spark, SMALL).collect(), "field")
    s = np.linalg.svd(x, compute_uv=False)
    rows = QUERIES["pod_energy"](spark, SMALL).orderBy("mode").collect()
    np.testing.assert_allclose([r.s for r in rows], s, rtol=1e-6)
    np.testing.assert_allclose([r.energy for r in rows], np.cumsum(s**2) / (s**2).sum(), rtol=1e-8)


def test_pod_reconstruct_against_svd(spark):
    rows = tables.fields(spark, SMALL).orderBy("run", "t").collect()
    x = matrix(rows, "field")
    v = np.linalg.svd(x, full_matrices=False)[2][:16]
    got = QUERIES["pod_reconstruct"](spark, SMALL).orderBy("run", "t").collect()
    np.testing.assert_allclose([r.rrmse for r in got], rrmse(x @ v.T @ v, x), rtol=1e-6)
    np.testing.assert_allclose(np.linalg.norm(matrix(got, "reduced"), axis=1), np.linalg.norm(x @ v.T, axis=1), rtol=1e-6)


@pytest.fixture(scope="module")
def learned(spark):
    """Tessellated observations and fields of the two parts, and a ridge fit on the first by least squares on widened rows."""
    train, validation = (part.orderBy("run", "t").collect() for part in queries.training(spark, SMALL))

    def fit(penalty: float) -> np.ndarray:
        a = np.hstack([matrix(train, "cell_value"), np.ones((len(train), 1))])
        ridge = np.sqrt(penalty) * np.eye(a.shape[1])[:-1]
        return np.linalg.lstsq(np.vstack([a, ridge]), np.vstack([matrix(train, "field"), np.zeros((len(ridge), 64))]), rcond=None)[0]

    return train, validation, lambda rows, w: matrix(rows, "cell_value") @ w[:-1] + w[-1], fit


def test_inverse_operator_against_least_squares(spark, learned):
    _, validation, infer, fit = learned
    residual = matrix(validation, "field") - infer(validation, fit(1.0))
    got = QUERIES["inverse_residuals"](spark, SMALL).orderBy("run", "t").collect()
    np.testing.assert_allclose(matrix(got, "residual"), residual, atol=1e-6)
    tries = QUERIES["inverse_operator_train"](spark, SMALL).orderBy("penalty").collect()
    want = [((matrix(validation, "field") - infer(validation, fit(p))) ** 2).mean() for p in (0.1, 1.0, 10.0)]
    np.testing.assert_allclose([r.loss for r in tries], want, rtol=1e-6)


def test_in_distribution_check_against_least_squares(spark, learned):
    train, _, infer, fit = learned
    ids = {(r.run, r.t) for r in selection.sample(queries.training(spark, SMALL)[0], 10, 1, "run", "t").collect()}
    some = [r for r in train if (r.run, r.t) in ids]
    want = rrmse(infer(some, fit(1.0)), matrix(some, "field"))
    r = QUERIES["in_distribution_check"](spark, SMALL).first()
    np.testing.assert_allclose([r["mean"], r["std"], r["min"], r["max"]], [want.mean(), want.std(), want.min(), want.max()], rtol=1e-5)


def test_split_is_exact_with_repeated_rows(spark):
    rows = spark.range(50).selectExpr("id % 10 AS t")
    for share in (0.1, 0.3, 0.5):
        assert selection.train_val_split(rows, share, 2, "t").where("part = 'val'").count() == round(share * 50)


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_quartiles_are_exact(spark, bins):
    rng = np.random.default_rng(bins)
    values = {k: rng.choice(rng.standard_normal(9), n).tolist() for k, n in (("a", 40), ("b", 1), ("c", 2), ("d", 33))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("d", None)], "method string, v double").repartition(3)
    for r in metrics.quartiles(df, ["method"], "v", bins).collect():
        np.testing.assert_allclose([r.q1, r.median, r.q3], np.quantile(values[r.method], [0.25, 0.5, 0.75]))


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_what_came_before_does_not_depend_on_buckets(spark, width):
    losses = np.random.default_rng(width).integers(0, 50, 60).tolist()
    df = spark.createDataFrame([(run, k, float(x)) for run in ("a", None) for k, x in enumerate(losses)], "run string, t int, loss double").repartition(3)
    for r in series.preceded(df, ["run"], "t", "loss", "before", width).collect():
        assert r.before == (losses[r.t - 1] if r.t else None)
    for r in metrics.running_best(df, ["run"], "t", width).collect():
        assert r.best == min(losses[: r.t + 1]) and r.improved == (not r.t or losses[r.t] < min(losses[: r.t]))


def test_weights_and_run_folders(spark, tmp_path):
    w = np.random.default_rng(0).standard_normal((5, 4))
    stores.write_weights(spark, w, str(tmp_path / "w"))
    np.testing.assert_array_equal(stores.read_weights(spark, str(tmp_path / "w")), w)
    a, b = (stores.run_folder(64, 0.1, "sin", {"tau0": t}) for t in (0.1, 0.1001))
    assert a != b and a.rsplit("_", 1)[0] == b.rsplit("_", 1)[0] == "N64/baro_N64_forcing-sin_tau0-0.1"
    stores.write_stack(tables.fields(spark, SMALL), str(tmp_path / "stack"))
    assert stores.file_sizes(spark, str(tmp_path / "stack")).where("length > 0").count() > 0
    plan = stores.read_stack(spark, str(tmp_path / "stack")).where("run = 3").select("t")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan and "ReadSchema: struct<t:bigint>" in plan
