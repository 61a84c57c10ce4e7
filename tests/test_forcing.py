"""Noise on modes: its mirror, its spectrum and that a rerun has the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions import grids
from fieldloom.operators import spectral

N = 8


def test_noise_is_hermitian_and_has_the_spectrum(spark):
    power = grids.forcing_spectrum(spark, N, 3.0, 2.0, 1.0, 0.5)
    want = np.zeros((N, N))
    for r in power.collect():
        want[r.ki, r.kj] = r.power
    numbers = F.sequence(F.lit(0), F.lit(N - 1))
    modes = spark.range(400).select(F.lit(1).alias("run"), F.col("id").alias("t"), F.explode(numbers).alias("ki")).select("run", "t", "ki", F.explode(numbers).alias("kj"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    rows = spectral.with_hermitian_noise(modes, power, N, 3).collect()
    z = np.zeros((400, N, N), complex)
    for r in rows:
        z[r.t, r.ki, r.kj] = r.re + 1j * r.im
    mirror = np.roll(z[:, ::-1, ::-1], 1, (1, 2))
    np.testing.assert_allclose(z, mirror.conj(), atol=1e-12)
    assert np.abs(np.fft.ifft2(z).imag).max() < 1e-12
    got = (np.abs(z) ** 2).mean(0)
    some = want > 0.05
    assert np.abs(got[some] / want[some] - 1).max() < 0.35 and abs((got[some] / want[some]).mean() - 1) < 0.05
    assert np.abs(np.corrcoef(z[:, 1, 2].real, z[:, 2, 1].real)[0, 1]) < 0.2
    again = spectral.with_hermitian_noise(modes.repartition(5), power, N, 3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
