"""Fourier transforms of fields, shell spectra, derivatives, mode series and radial statistics.

Packed operators (one row a field) transform whole Arrow batches with numpy's FFT and shuffle nothing.
``dft2_cells`` and ``idft2_cells`` are the same transforms as joins with a twiddle table, for small grids
or where Python is unwelcome. Complex numbers are two columns, re and im.
"""

from __future__ import annotations

import math

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import grids, scalar
from fieldloom.operators.batch import map_fields

MODES = {"(1,0)": (0, 1), "(0,1)": (1, 0), "(1,1)": (1, 1), "(-1,1)": (1, -1)}  # label: (ki, kj), -1 being the last index


def waves(n: int, derivative: bool = False) -> np.ndarray:
    k = np.arange(n, dtype=np.float64)
    k[k > n / 2] -= n
    if derivative:
        k[n // 2] = 0
    return k


def _norms(n: int) -> tuple[np.ndarray, np.ndarray]:
    """k^2 of each mode, and its inverse with 0 at 0."""
    k = waves(n)
    k2 = k[:, None] ** 2 + k[None, :] ** 2
    return k2, np.divide(1.0, k2, out=np.zeros_like(k2), where=k2 > 0)


@lru_cache(maxsize=8)
def _shells(n: int) -> tuple[np.ndarray, ...]:
    """Modes within n/2, the shell below each one's norm, the shell above, and the share of the upper one."""
    k = np.sqrt(_norms(n)[0]).ravel()
    low, high = np.floor(k).astype(int), np.ceil(k).astype(int)
    inside = np.flatnonzero(high <= n // 2)
    return inside, low[inside], high[inside], (k - low)[inside]


def shell_sums(flat: np.ndarray, n: int) -> np.ndarray:
    """(rows, n/2 + 1): each mode of (rows, n * n) shared among the two shells around its norm; none if it lies beyond n/2."""
    inside, low, high, upper = _shells(n)
    out = np.empty((len(flat), n // 2 + 1))
    for row, x in zip(out, flat[:, inside], strict=True):
        row[:] = np.bincount(low, x * (1 - upper), n // 2 + 1) + np.bincount(high, x * upper, n // 2 + 1)
    return out


def fft2(fields: DataFrame, column: str = "field") -> DataFrame:
    """Adds re and im, the unnormalised transform of a field."""

    def compute(n: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        f = np.fft.fft2(x)
        return f.real, f.imag

    return map_fields(fields, [column], {"re": "array", "im": "array"}, compute)


def ifft2(spectral: DataFrame, name: str = "field") -> DataFrame:
    """Adds the real part of the inverse transform of re and im."""
    return map_fields(spectral, ["re", "im"], {name: "array"}, lambda n, re, im: (np.fft.ifft2(re + 1j * im).real,))


def dft2_cells(cells: DataFrame, n: int) -> DataFrame:
    """run, t, ki, kj, re, im of run, t, i, j, v: one join and sum for each axis."""
    w = F.broadcast(grids.twiddles(cells.sparkSession, n))  # n * n rows
    rows = cells.join(w, F.col("j") == F.col("m")).groupBy("run", "t", "i", F.col("k").alias("kj")).agg(F.sum(F.col("v") * F.col("c")).alias("a"), F.sum(F.col("v") * F.col("s")).alias("b"))
    re, im = scalar.times((F.col("a"), F.col("b")), (F.col("c"), F.col("s")))
    return rows.join(w, F.col("i") == F.col("m")).groupBy("run", "t", F.col("k").alias("ki"), "kj").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def idft2_cells(modes: DataFrame, n: int) -> DataFrame:
    """run, t, i, j, v: the real part of the inverse transform of run, t, ki, kj, re, im."""
    w = F.broadcast(grids.twiddles(modes.sparkSession, n).select("k", "m", "c", (-F.col("s")).alias("s")))
    re, im = scalar.times((F.col("re"), F.col("im")), (F.col("c"), F.col("s")))
    rows = modes.join(w, F.col("kj") == F.col("m")).groupBy("run", "t", "ki", F.col("k").alias("j")).agg(F.sum(re).alias("a"), F.sum(im).alias("b"))
    re, _ = scalar.times((F.col("a"), F.col("b")), (F.col("c"), F.col("s")))
    return rows.join(w, F.col("ki") == F.col("m")).groupBy("run", "t", F.col("k").alias("i"), "j").agg((F.sum(re) / (n * n)).alias("v"))


def with_hermitian_noise(modes: DataFrame, power: DataFrame, n: int, seed: int) -> DataFrame:
    """run, t, ki, kj, re, im with a seeded normal number of variance ``power`` (ki, kj, power; n * n rows, the same for a mode and its mirror) added to each mode.

    A mode and its mirror (-ki, -kj) draw from one counter, keyed by run, t and the smaller of the two, and get conjugate numbers, a mode that is its own
    mirror a real one: the field stays real, and no mode has to know of another.
    """
    mirror = [F.pmod(-F.col(k), F.lit(n)).cast("int") for k in ("ki", "kj")]
    low = F.least(F.struct(F.col("ki").cast("int").alias("i"), F.col("kj").cast("int").alias("j")), F.struct(mirror[0].alias("i"), mirror[1].alias("j")))
    met = modes.join(F.broadcast(power), ["ki", "kj"]).withColumn("_low", low)
    u = lambda salt: scalar.uniform(F.col("run"), F.col("t"), F.col("_low.i"), F.col("_low.j"), F.lit(seed), F.lit(salt))
    size, turn = F.sqrt(-2 * F.ln(u(0))) * F.sqrt("power"), 2 * math.pi * u(1)
    own, first = (F.col("ki") == mirror[0]) & (F.col("kj") == mirror[1]), (F.col("ki") == F.col("_low.i")) & (F.col("kj") == F.col("_low.j"))
    re = F.when(own, size * F.cos(turn)).otherwise(size * F.cos(turn) / math.sqrt(2))
    im = F.when(own, 0.0).when(first, size * F.sin(turn) / math.sqrt(2)).otherwise(-size * F.sin(turn) / math.sqrt(2))
    return met.select("run", "t", "ki", "kj", (F.col("re") + re).alias("re"), (F.col("im") + im).alias("im"))


def mode_rows(spectral: DataFrame) -> DataFrame:
    """run, t, n, ki, kj, re, im: a row for each mode of packed re and im."""
    flat = spectral.select("run", "t", "n", F.posexplode(F.arrays_zip("re", "im")).alias("p", "z"))
    return flat.select("run", "t", "n", F.expr("p div n").cast("int").alias("ki"), (F.col("p") % F.col("n")).alias("kj"), "z.re", "z.im")


def centred(index: str, n: int) -> Column:
    """Position of a mode once zero is moved to the middle."""
    return F.pmod(F.col(index) + n // 2, F.lit(n))


def shell_spectrum(fields: DataFrame, column: str = "field") -> DataFrame:
    """run, t, k, energy and enstrophy: squared amplitudes shared among the two shells around each mode's norm."""

    def compute(n: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        power = np.abs(np.fft.fft2(x)) ** 2
        flat = power.reshape(len(x), -1) * (0.5 / n**4)
        return shell_sums(flat * _norms(n)[1].ravel(), n), shell_sums(flat, n)

    found = map_fields(fields, [column], {"energy": "array", "enstrophy": "array"}, compute, ["run", "t"])
    return found.select("run", "t", F.posexplode(F.arrays_zip("energy", "enstrophy")).alias("k", "s")).select("run", "t", "k", "s.energy", "s.enstrophy")


def time_mean_spectrum(spectrum: DataFrame) -> DataFrame:
    """run, k, energy and enstrophy: means over time, without k = 0."""
    return spectrum.where("k > 0").groupBy("run", "k").agg(F.avg("energy").alias("energy"), F.avg("enstrophy").alias("enstrophy"))


def total_energy(spectrum: DataFrame) -> DataFrame:
    return spectrum.groupBy("run", "t").agg(F.sum("energy").alias("energy"))


def amplitudes(modes: DataFrame) -> DataFrame:
    """Mode rows with re and im scaled by -1 / (|k| n^2), 0 at k = 0: the velocity amplitude of the streamfunction."""
    ky, kx = scalar.wave(F.col("ki"), F.col("n")), scalar.wave(F.col("kj"), F.col("n"))
    k = F.sqrt((kx * kx + ky * ky).cast("double"))
    by = F.when(k == 0, 0.0).otherwise(-1 / (k * F.col("n") * F.col("n")))
    return modes.withColumn("k", k).withColumn("re", F.col("re") * by).withColumn("im", F.col("im") * by)


def into_shells(modes: DataFrame, keys: list[str], values: list[str], n: int, scale: float = 1.0) -> DataFrame:
    """Sums of ``values`` by keys and shell; ``modes`` has k, and those beyond n/2 are left out."""
    low = F.floor("k").cast("int")
    part = F.col("k") - low
    shells = F.explode(F.array(F.struct(low.alias("shell"), (1 - part).alias("w")), F.struct(F.ceil("k").cast("int").alias("shell"), part.alias("w"))))
    flat = modes.where(F.ceil("k") <= n // 2).select(*keys, *values, shells.alias("s"))
    return flat.groupBy(*keys, F.col("s.shell").alias("k")).agg(*[(scale * F.sum(F.col(v) * F.col("s.w"))).alias(v) for v in values])


def mean_var_spectrum(fields: DataFrame, n: int) -> DataFrame:
    """run, k, mean and variance spectra: of each mode's mean over time, and of its sample variance."""
    scaled = amplitudes(mode_rows(fft2(fields)))
    per_mode = scaled.groupBy("run", "ki", "kj", "k").agg(scalar.abs2(F.avg("re"), F.avg("im")).alias("mean"), (F.var_samp("re") + F.var_samp("im")).alias("variance"))
    return into_shells(per_mode, ["run"], ["mean", "variance"], n, 0.5)


def mode_series(fields: DataFrame, n: int) -> DataFrame:
    """run, t, mode, re, im: the scaled series of the four slowest modes; computed from the modes asked for alone."""
    at = {label: (ki % n) * n + kj % n for label, (ki, kj) in MODES.items()}

    def compute(size: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        f = -np.fft.fft2(x).reshape(len(x), -1)[:, list(at.values())] * np.sqrt(_norms(size)[1].ravel()[list(at.values())]) / size**2
        return f.real, f.imag

    found = map_fields(fields, ["field"], {"re": "array", "im": "array"}, compute, ["run", "t"])
    names = F.array(*map(F.lit, at))
    return found.select("run", "t", F.explode(F.arrays_zip(names.alias("mode"), "re", "im")).alias("z")).select("run", "t", "z.mode", "z.re", "z.im")


def power_law_fit(spectrum: DataFrame, keys: list[str], value: str, forcing: str = "sin") -> DataFrame:
    """keys, amplitude and exponent of value = amplitude k^exponent in log space over positive values; 1 without any."""
    top, exponent = (35, -5 / 3) if forcing == "constant" else (45, -3.0)
    usable = (F.col("k") >= 1) & (F.col("k") <= top) & (F.col(value) > 0)
    amplitude = F.exp(F.avg(F.when(usable, F.ln(value) - exponent * F.ln("k"))))
    return spectrum.groupBy(*keys).agg(F.coalesce(amplitude, F.lit(1.0)).alias("amplitude"), F.lit(exponent).alias("exponent"))


def flow(fields: DataFrame) -> DataFrame:
    """run, t, n and the packed fields psi, u, v, qx and qy that a vorticity field q determines."""

    def compute(n: int, q: np.ndarray) -> tuple[np.ndarray, ...]:
        f, d = np.fft.fft2(q), 1j * waves(n, derivative=True)
        psi, dx, dy = -f * _norms(n)[1], d[None, :], d[:, None]
        return tuple(np.fft.ifft2(x).real for x in (psi, -dy * psi, dx * psi, dx * f, dy * f))

    return map_fields(fields, ["field"], dict.fromkeys(("psi", "u", "v", "qx", "qy"), "array"), compute, ["run", "t", "n"])


def zonal_mean(fields: DataFrame) -> DataFrame:
    """run, t, i, u: zonal velocity averaged along x."""
    u = flow(fields)
    row = lambda i: F.aggregate(F.slice("u", i * F.col("n") + 1, F.col("n")), F.lit(0.0), lambda a, x: a + x) / F.col("n")
    return u.select("run", "t", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), row)).alias("i", "u"))


def meridional_flux(fields: DataFrame) -> DataFrame:
    """run, t, vb_re, vb_im and vb_physical.

    vb_re and vb_im sum the physical v times the spectral q of the same position, as the reference results
    do; vb_physical sums v times the physical q. Both are times the cell's area.
    """

    def compute(n: int, q: np.ndarray) -> tuple[np.ndarray, ...]:
        f, d = np.fft.fft2(q), 1j * waves(n, derivative=True)
        v = np.fft.ifft2(d[None, :] * -f * _norms(n)[1]).real
        area, mixed = (2 * math.pi / n) ** 2, (v * f).sum((1, 2))
        return area * mixed.real, area * mixed.imag, area * (v * q).sum((1, 2))

    return map_fields(fields, ["field"], dict.fromkeys(("vb_re", "vb_im", "vb_physical"), "double"), compute, ["run", "t"])


def radial_autocorrelation(fields: DataFrame) -> DataFrame:
    """run, t, r, acf: periodic autocorrelation of the demeaned field, averaged over whole radii below n/2."""

    def compute(n: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        f = np.fft.fft2(x - x.mean((1, 2), keepdims=True))
        acf = np.fft.ifft2(np.abs(f) ** 2).real.reshape(len(x), -1)
        d = np.minimum(np.arange(n), n - np.arange(n))
        r = np.sqrt(d[:, None] ** 2 + d[None, :] ** 2).astype(int).ravel()
        means = np.stack([acf[:, r == k].mean(1) for k in range(n // 2)], axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (means / acf[:, :1],)

    found = map_fields(fields, ["field"], {"acf": "array"}, compute, ["run", "t"])
    return found.select("run", "t", F.posexplode("acf").alias("r", "acf"))


def correlation_length(radial: DataFrame, most: int = 10) -> DataFrame:
    """length and snapshots: the first radius at which the mean over the first ``most`` snapshots is below 1/e, else the last."""
    first = radial.select("run", "t").distinct().orderBy("t", "run").limit(most)
    mean = radial.join(F.broadcast(first), ["run", "t"]).groupBy("r").agg(F.avg("acf").alias("acf"))
    return mean.agg(F.coalesce(F.min(F.when(F.col("acf") < math.exp(-1), F.col("r"))), F.max("r")).alias("length")).crossJoin(first.agg(F.count("*").alias("snapshots")))


def running_moments(modes: DataFrame) -> DataFrame:
    """run, ki, kj, the sums of q and of |q|^2 over time, and how many."""
    return modes.groupBy("run", "ki", "kj").agg(F.sum("re").alias("s1_re"), F.sum("im").alias("s1_im"), F.sum(scalar.abs2(F.col("re"), F.col("im"))).alias("s2"), F.count("*").alias("n_records"))


def tendency(fields: DataFrame, beta: float = 1.0, drag: float = 0.1) -> DataFrame:
    """run, t, n, re, im: spectral tendency -beta dpsi/dx - drag q - J(psi, q) of vorticity fields, products on a 3/2 grid."""

    def padded(x: np.ndarray, n: int) -> np.ndarray:
        m, h = 3 * n // 2, n // 2
        out = np.zeros((*x.shape[:-2], m, m), dtype=complex)
        at = np.r_[0 : h + 1, m - h + 1 : m]
        out[..., at[:, None], at[None, :]] = x * 9 / 4
        return out

    def compute(n: int, q: np.ndarray) -> tuple[np.ndarray, ...]:
        f, m, h = np.fft.fft2(q), 3 * n // 2, n // 2
        psi, d = -f * _norms(n)[1], 1j * waves(n, derivative=True)
        wide = 1j * waves(m, derivative=True)
        dx, dy, big_psi, big_q = wide[None, :], wide[:, None], padded(psi, n), padded(f, n)
        u, v, qx, qy = (np.fft.ifft2(x).real for x in (-dy * big_psi, dx * big_psi, dx * big_q, dy * big_q))
        at = np.r_[0 : h + 1, m - h + 1 : m]
        jacobian = (np.fft.fft2(u * qx + v * qy) * 4 / 9)[..., at[:, None], at[None, :]]
        out = -beta * d[None, :] * psi - drag * f - jacobian
        return out.real, out.imag

    return map_fields(fields, ["field"], {"re": "array", "im": "array"}, compute, ["run", "t", "n"])


def demeaned(cells: DataFrame) -> DataFrame:
    """Cells less their field's mean."""
    return cells.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("run", "t")))
