"""Operators against numpy and against what is known of their results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import grids
from fieldloom.operators import assimilation, covariance, ensemble, learning, metrics, selection, sensors, series, spectral
from fieldloom.operators.assimilation import added, dense, minimise, observation, quadratic
from fieldloom.sources import stores, tables

N = 16


def stack(spark, fields: list[np.ndarray], run: int = 0):
    rows = [(run, t, len(x), [float(v) for v in x.ravel()]) for t, x in enumerate(fields)]
    return spark.createDataFrame(rows, "run int, t int, n int, field array<double>").repartition(3)


def field(df, column: str, n: int = N) -> np.ndarray:
    return np.array([r[column] for r in df.orderBy("t").collect()]).reshape(-1, n, n)


@pytest.fixture(scope="module")
def noise():
    return [np.random.default_rng(k).standard_normal((N, N)) for k in range(6)]


def test_constant_field_has_no_power_above_zero(spark):
    s = spectral.shell_spectrum(stack(spark, [np.full((N, N), 3.0)])).where("k > 0")
    assert s.agg(F.max("energy"), F.max("enstrophy")).first() == (0.0, 0.0)


def test_a_cosine_lies_in_its_shell(spark):
    x = np.cos(2 * np.pi * 3 * np.arange(N) / N)[None, :].repeat(N, 0)
    got = {r.k: r.enstrophy for r in spectral.shell_spectrum(stack(spark, [x])).collect()}
    assert got[3] == pytest.approx(0.25) and sum(v for k, v in got.items() if k != 3) < 1e-25


def test_shell_spectrum_against_loops(spark, noise):
    f, want = np.fft.fft2(noise[0]), np.zeros(N // 2 + 1)
    for a in range(N):
        for b in range(N):
            k = np.hypot(a - N * (a > N / 2), b - N * (b > N / 2))
            if np.ceil(k) <= N // 2:
                want[int(np.floor(k))] += (1 - (k - np.floor(k))) * abs(f[a, b]) ** 2 / 2 / N**4
                want[int(np.ceil(k))] += (k - np.floor(k)) * abs(f[a, b]) ** 2 / 2 / N**4
    got = [r.enstrophy for r in spectral.shell_spectrum(stack(spark, noise[:1])).orderBy("k").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_transform_as_join_equals_fft(spark, noise):
    got = np.zeros((N, N), complex)
    for r in spectral.dft2_cells(tables.cells(stack(spark, noise[:1])), N).collect():
        got[r.ki, r.kj] = r.re + 1j * r.im
    np.testing.assert_allclose(got, np.fft.fft2(noise[0]), atol=1e-10)


def test_parseval(spark, noise):
    modes = spectral.mode_rows(spectral.fft2(stack(spark, noise[:1])))
    assert modes.agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).first()[0] == pytest.approx(N * N * (noise[0] ** 2).sum())


def test_partitions_do_not_matter(spark, noise):
    a, b = (sorted(map(tuple, spectral.mean_var_spectrum(stack(spark, noise).repartition(k), N).collect())) for k in (1, 5))
    np.testing.assert_allclose(a, b, rtol=1e-10)


def test_power_law_is_recovered(spark):
    s = spark.createDataFrame([(0, k, 7.0 * k**-3.0) for k in range(1, 9)], "run int, k int, energy double")
    assert spectral.power_law_fit(s, ["run"], "energy").first().amplitude == pytest.approx(7.0)
    none = spark.createDataFrame([(0, 1, 0.0)], "run int, k int, energy double")
    assert spectral.power_law_fit(none, ["run"], "energy").first().amplitude == 1.0


def test_flow_of_one_wave(spark):
    y = 2 * np.pi * np.arange(N) / N
    q = np.sin(2 * y)[:, None].repeat(N, 1)  # psi = -q / 4, u = -dpsi/dy
    u = field(spectral.flow(stack(spark, [q])), "u")[0]
    np.testing.assert_allclose(u, 0.5 * np.cos(2 * y)[:, None].repeat(N, 1), atol=1e-12)


def test_radial_autocorrelation_starts_at_one(spark, noise):
    rows = spectral.radial_autocorrelation(stack(spark, noise)).where("r = 0").collect()
    assert all(r.acf == pytest.approx(1.0) for r in rows)


def test_tendency_of_a_zonal_flow_is_drag_alone(spark):
    q = np.sin(2 * np.pi * np.arange(N) / N)[:, None].repeat(N, 1)
    r = spectral.tendency(stack(spark, [q]), drag=0.3)
    got = field(r, "re")[0] + 1j * field(r, "im")[0]
    np.testing.assert_allclose(got, -0.3 * np.fft.fft2(q), atol=1e-9)


def test_resampling_is_exact_on_a_ramp(spark):
    rows = [("a", us, k, 2.0 * us) for k, us in enumerate([0, 7, 10, 31, 31, 45])] + [("b", 5, 0, 1.0)]
    got = series.resampled(spark.createDataFrame(rows, "run string, us long, id long, v double"), 10).collect()
    assert sorted((r.run, r.us, r.v) for r in got) == [("a", k, 2.0 * k) for k in (0, 10, 20, 30, 40)]


def test_autocorrelation_against_numpy(spark):
    x = np.random.default_rng(1).standard_normal(60)
    rows = spark.createDataFrame([(0, k, float(v), 0.0) for k, v in enumerate(x)], "run int, pos int, re double, im double")
    c = x - x.mean()
    want = [float(c[k:] @ c[:-k] / (c @ c)) for k in range(1, 6)]
    got = [r.acf for r in series.full_autocorrelation(rows, ["run"]).where("lag <= 5").orderBy("lag").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-10)


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100, 10_000])
def test_evenly_spaced_positions(spark, n):
    rows = spark.range(n).select(F.lit(0).alias("run"), F.col("id").alias("t"))
    got = sorted(r.position for r in series.evenly(rows, 20, "t").collect())
    assert got == sorted(set(np.linspace(0, n - 1, min(n, 20), dtype=int).tolist()))


def test_sensors_tie_to_the_lowest(spark):
    x = stack(spark, [np.arange(64.0).reshape(8, 8)]).withColumn("si", F.array(*map(F.lit, [0, 0, 7]))).withColumn("sj", F.array(*map(F.lit, [0, 2, 7]))).withColumn("y", sensors.sampled())
    r = sensors.tessellated(x).first()
    assert r.cell_sensor[1] == 0 and r.cell_value[1] == 0.0 and r.cell_sensor[63] == 2 and r.y == [0.0, 2.0, 63.0]


def test_sensors_stay_on_the_grid_and_repeat(spark, noise):
    a, b = (sensors.placed(stack(spark, noise), 4, 3.0).orderBy("t").select("si", "sj").collect() for _ in range(2))
    assert a == b and all(0 <= v < N for r in a for v in r.si + r.sj)


def test_nonlinear_observation_against_loops(spark, noise):
    x, want = noise[0], np.zeros((N, N))
    for di in range(-3, 4):
        for dj in range(-3, 4):
            r = di * di + dj * dj
            want += (0.5 * (r <= 9) + (r <= 2.25)) * np.roll(x, (-di, -dj), (0, 1)) ** 2
    np.testing.assert_allclose(field(sensors.nonlinear(stack(spark, [x])), "observed")[0], want, rtol=1e-10)


def test_taper_is_continuous_and_compact():
    assert covariance.taper(np.array([0.0]))[0] == 1 and covariance.taper(np.array([2.0, 3.0])).tolist() == [0, 0]
    np.testing.assert_allclose(covariance.taper(np.array([1 - 1e-9, 1.0])), 5 / 24, atol=1e-8)


def test_covariance_round_trip_on_a_smooth_field(spark):
    x = np.cos(2 * np.pi * np.arange(N) / N)[:, None] * np.ones(N)
    s = covariance.correlation_spectrum(N, 3.0)
    there = covariance.filtered(stack(spark, [x]), s, "c").select("run", "t", "n", F.col("c").alias("field"))
    np.testing.assert_allclose(field(covariance.filtered(there, s, "b", inverse=True), "b")[0], x, atol=1e-5)


def test_background_noise_has_unit_deviation_and_repeats(spark, noise):
    a, b = (field(covariance.with_background(stack(spark, noise), 0.5, 3.0), "noise") for _ in range(2))
    np.testing.assert_allclose(a.std((1, 2)), 1)
    assert (a == b).all()


def test_basis_of_a_rank_two_stack(spark):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((2, 8, 8))
    x = stack(spark, [c * a + e * b for c, e in rng.standard_normal((9, 2))])
    basis, s = covariance.pod(x, 2)
    assert s[2] < 1e-6 * s[0]
    np.testing.assert_allclose(s[:2], np.linalg.svd(field(x, "field", 8).reshape(9, -1), compute_uv=False)[:2], rtol=1e-8)
    assert covariance.projected(x, basis).select(F.max(metrics.relative_rmse("restored", "field"))).first()[0] < 1e-7


@pytest.mark.parametrize("length", [0.4, 1.0, 1.5, 6.0])
def test_localized_covariance_forms_agree(spark, length):
    x = [np.random.default_rng(k).standard_normal((8, 8)) for k in range(5)]
    want = covariance.dense_localized(stack(spark, x).withColumn("residual", F.col("field")), 8, length)
    for found in (covariance.localized_covariance(tables.cells(stack(spark, x)), length), covariance.localized_moments(stack(spark, x).repartition(3), length)):
        got = np.zeros((64, 64))
        for r in found.collect():
            got[r.ai * 8 + r.aj, r.bi * 8 + r.bj] = r.p
        np.testing.assert_allclose(got, want, atol=1e-10)


def test_perfect_estimate(spark, noise):
    pairs = stack(spark, noise).select("run", "t", "n", F.col("field").alias("x_true"), F.col("field").alias("x_est"))
    r = metrics.ssim(pairs).select("ssim", metrics.relative_rmse().alias("rrmse")).collect()
    assert all(x.rrmse == 0 and x.ssim == pytest.approx(1) for x in r)


def test_split_counts_are_exact(spark):
    rows = spark.range(130).withColumnRenamed("id", "t")
    parts = {r.part: r["count"] for r in selection.train_val_split(rows, 0.05, 1, "t").groupBy("part").count().collect()}
    assert parts == {"val": 6, "train": 124}  # 6.5 goes to the even 6


@pytest.mark.parametrize("nonlinear", [False, True])
def test_gradients_against_differences(nonlinear):
    rng = np.random.default_rng(2)
    x, c, at = rng.standard_normal(64), rng.standard_normal(64), np.array([0, 9, 9, 33])
    s = covariance.correlation_spectrum(8, 2.0) + 0.1
    m = rng.standard_normal((64, 64))
    f = added(quadratic(c, 1 / s), dense(c, m @ m.T), observation(8, at, rng.standard_normal(4), 0.3, nonlinear))
    d = rng.standard_normal(64)
    assert f(x)[1] @ d == pytest.approx((f(x + 1e-6 * d)[0] - f(x - 1e-6 * d)[0]) / 2e-6, rel=1e-5)


def test_minimiser_solves_a_quadratic():
    rng = np.random.default_rng(3)
    m, b = rng.standard_normal((20, 20)), rng.standard_normal(20)
    a = m @ m.T + np.eye(20)
    x, rounds, costs = minimise(lambda x: (0.5 * x @ a @ x - b @ x, a @ x - b), np.zeros(20))
    np.testing.assert_allclose(x, np.linalg.solve(a, b), atol=1e-3)
    assert rounds < 200 and costs[-1] < costs[0]


def test_analysis_without_innovation_is_the_background(spark):
    x = stack(spark, [np.random.default_rng(1).standard_normal((8, 8))]).withColumn("x_b", F.col("field"))
    x = sensors.placed(x, 3).withColumn("y", sensors.sampled())
    r = assimilation.analysed(x, 2.0, 0.1, 0.05).first()
    assert r.x_da == r.x_b and r.x_da_iterations == 0


def test_analysis_lowers_the_error_at_sensors(spark, noise):
    x = stack(spark, noise)
    x = sensors.placed(covariance.with_background(x, 0.5, 3.0), 6).withColumn("y", sensors.sampled())
    r = assimilation.analysed(x, 3.0, 0.5, 0.01).select(metrics.relative_rmse("x_b", "field"), metrics.relative_rmse("x_da", "field")).collect()
    assert all(after < before for before, after in r)


def test_inverse_operator_recovers_a_linear_map(spark):
    rng = np.random.default_rng(4)
    w = rng.standard_normal((9, 4))
    rows = [(k, 2, [float(v) for v in x], [float(v) for v in np.append(x, [0.0] * 5)[:4] @ w[:4] + w[8]]) for k, x in enumerate(rng.standard_normal((40, 4)))]
    df = spark.createDataFrame(rows, "t int, n int, cell_value array<double>, field array<double>")
    got = learning.residuals(df, learning.fit_inverse(df, 1e-9)).agg(F.max(F.array_max("residual"))).first()[0]
    assert abs(got) < 1e-6


def test_runge_kutta_tableau_is_consistent():
    for e, i in zip(ensemble.EXPLICIT, ensemble.IMPLICIT, strict=True):
        assert abs(float(sum(e)) - float(sum(i)) - (ensemble.DIAGONAL if e else 0)) < 1e-9
    assert float(sum(ensemble.WEIGHTS)) == pytest.approx(1) and float(sum(ensemble.LOWER)) == pytest.approx(1)


def test_step_is_of_high_order():
    y, x = np.meshgrid(2 * np.pi * np.arange(32) / 32, 2 * np.pi * np.arange(32) / 32, indexing="ij")
    q = np.fft.fft2(np.sin(x) + 0.5 * np.cos(y) + 0.3 * np.cos(x + y))  # nothing near the grid's limit
    d = ensemble.Dynamics(32, 1.0, 0.1, 0.2, nu=0.0)

    def run(n):
        z = q
        for _ in range(n):
            z, _ = d.step(z, 1.0 / n)
        return z

    fine = run(64)
    assert np.abs(run(4) - fine).max() > 10 * np.abs(run(8) - fine).max()


def test_ensemble_gives_uniform_times(spark):
    m = spark.createDataFrame([("a", 8, 0.1), ("b", 8, 0.2)], "run string, n int, tau0 double")
    rows = ensemble.simulated(m, 0.2, 0.05, 4, nu=1e-12).collect()
    for run in "ab":
        times = sorted(r.time for r in rows if r.run == run)
        assert len(times) == 4 and times[0] >= 0.2
        np.testing.assert_allclose(np.diff(times), 0.05)


def test_no_coefficient_for_an_odd_grid():
    with pytest.raises(ValueError):
        grids.hyperviscosity(100)


def test_raw_source_reads_records(spark, tmp_path):
    z = np.random.default_rng(0).standard_normal((5, 2, 4, 4))
    (tmp_path / "qh.bin").write_bytes(z.tobytes() + b"tail")
    got = stores.raw_spectral(spark, str(tmp_path / "qh.bin"), 4, 2).orderBy("t").collect()
    np.testing.assert_array_equal([r.re + r.im for r in got], z.reshape(5, 32))


def test_cache_is_keyed_by_parameters(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for p, force in ((0.012, False), (0.012, False), (0.0121, False), (0.012, True)):
        assert stores.cached(spark, str(tmp_path), "x", {"dt": p}, make, force).count() == 3
    assert len(made) == 3


def test_first_existing(spark, tmp_path):
    assert tables.first_existing(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [str(tmp_path / "no")])


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_buckets_do_not_matter(spark, bucket):
    rng = np.random.default_rng(bucket)
    rows = [(r, int(us), k, float(v)) for r in ("a", None) for k, (us, v) in enumerate(zip(np.sort(rng.integers(0, 400, 60)), rng.standard_normal(60), strict=True))]
    df = spark.createDataFrame(rows, "run string, us long, id long, v double").repartition(3)
    got = series.numbered(df, ["run"], ["us", "id"], bucket * 10).collect()
    assert all(r.position == r.id and r.total == 60 for r in got) and len(got) == 120
    one = lambda f: sorted(map(str, f.collect()))
    assert one(series.resampled(df, 10, bucket)) == one(series.resampled(df, 10, 10**6))


def test_split_border_lies_in_one_bin(spark):
    rows = spark.range(500).withColumnRenamed("id", "t")
    parts = [sorted(r.t for r in selection.train_val_split(rows, 0.1, 2, "t", bins=b).where("part = 'val'").collect()) for b in (1, 7, 1 << 16)]
    assert parts[0] == parts[1] == parts[2] and len(parts[0]) == 50
    assert selection.train_val_split(rows.where("t < 0"), 0.1, 2, "t").count() == 0


def test_gram_over_blocks_and_sizes(spark):
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((30, 9)), rng.standard_normal((5, 4))
    df = spark.createDataFrame([(v.tolist(),) for v in [*x, *y]] + [(None,)], "field array<double>").repartition(3)
    want = x.T @ x
    want[:4, :4] += y.T @ y
    for block in (2, 4, 512):
        got = {(r.a, r.b): r.g for r in covariance.gram(df, block=block).collect()}
        assert got == pytest.approx({(a, b): want[a, b] for a in range(9) for b in range(a, 9)})
    assert covariance.gram(df.where("false")).count() == 0
