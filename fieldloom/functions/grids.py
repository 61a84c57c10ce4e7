"""Dimension tables that a grid's size alone determines; n * n rows or fewer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import scalar


def index_grid(spark: SparkSession, n: int) -> DataFrame:
    """p, i, j of every cell, row by row."""
    p = spark.range(n * n).select(F.col("id").cast("int").alias("p"))
    return p.select("p", F.expr(f"p div {n}").cast("int").alias("i"), (F.col("p") % n).alias("j"))


def wave_grid(spark: SparkSession, n: int) -> DataFrame:
    """ki, kj with wavenumbers ky, kx, those for derivatives dky, dkx, and the norm k."""
    grid = index_grid(spark, n).select(F.col("i").alias("ki"), F.col("j").alias("kj"))
    grid = grid.select("ki", "kj", *[f(F.col(c), n).cast("double").alias(a) for f, c, a in ((scalar.wave, "ki", "ky"), (scalar.wave, "kj", "kx"), (scalar.wave_derivative, "ki", "dky"), (scalar.wave_derivative, "kj", "dkx"))])
    return grid.withColumn("k", F.sqrt(F.col("kx") ** 2 + F.col("ky") ** 2))


def twiddles(spark: SparkSession, n: int) -> DataFrame:
    """k, m, c, s: cos and -sin of 2 pi k m / n."""
    a = 2 * math.pi * F.pmod(F.col("i") * F.col("j"), F.lit(n)) / n
    return index_grid(spark, n).select(F.col("i").alias("k"), F.col("j").alias("m"), F.cos(a).alias("c"), (-F.sin(a)).alias("s"))


def disk_offsets(spark: SparkSession, radius: float) -> DataFrame:
    """di, dj of the cells at most ``radius`` from a cell."""
    r = int(radius)
    grid = index_grid(spark, 2 * r + 1).select((F.col("i") - r).alias("di"), (F.col("j") - r).alias("dj"))
    return grid.where(F.col("di") * F.col("di") + F.col("dj") * F.col("dj") <= radius * radius)


def radial_kernel(spark: SparkSession, n: int, length: float, localize: bool = False) -> DataFrame:
    """i, j and v, the Matern correlation of each cell with cell (0, 0) on a periodic grid, tapered if asked."""
    di, dj = scalar.wrapped(F.col("i"), n), scalar.wrapped(F.col("j"), n)
    grid = index_grid(spark, n).withColumn("r", F.sqrt((di * di + dj * dj).cast("double")))
    value = scalar.matern32(F.col("r"), length)
    return grid.select("i", "j", (value * scalar.gaspari_cohn(F.col("r") / length) if localize else value).alias("v"))


def wind_stress(spark: SparkSession, n: int, shape: str = "sin", tau0: float = 0.1, width: float = 1.0) -> DataFrame:
    """i, j, y and tau on [-pi, pi): 'sin' is tau0 sin(y)^2, 'sech2' tau0 sech(y / width)^2, 'constant' tau0."""
    grid = index_grid(spark, n).withColumn("y", -math.pi + F.col("i") * (2 * math.pi / n))
    tau = {"sin": tau0 * F.sin("y") ** 2, "sech2": tau0 * scalar.sech2(F.col("y") / width), "constant": F.lit(float(tau0))}[shape]
    return grid.select("i", "j", "y", tau.alias("tau"))


#: Hyperviscosity coefficients by grid size, before the forcing wavenumber's power.
HYPERVISCOSITY = {64: 1.64e-23, 128: 2.5e-28, 256: 5e-33, 512: 1e-34}
ORDER = 8  # of the hyperviscosity


def hyperviscosity(n: int, kf: float = 50.0, epsf: float = 0.0, tau0: float = 0.1) -> float:
    """nu of a grid size; raises ValueError for a size without a coefficient."""
    if n not in HYPERVISCOSITY:
        raise ValueError(f"no hyperviscosity coefficient for n={n}; there are ones for {sorted(HYPERVISCOSITY)}")
    scale = (50.0 if n == 128 and epsf == 0 else kf) / 50
    return HYPERVISCOSITY[n] * scale ** (-2 * ORDER + 2 / 3) * (100 if n == 256 and tau0 == 0 else 1)


def damping(spark: SparkSession, n: int, nu: float, order: int = ORDER) -> DataFrame:
    """ki, kj and rate, -nu k^(2 order)."""
    return wave_grid(spark, n).select("ki", "kj", (-nu * F.col("k") ** (2 * order)).alias("rate"))


def forcing_spectrum(spark: SparkSession, n: int, kf: float, epsf: float, sigf: float, alpf: float) -> DataFrame:
    """ki, kj and power of the stochastic forcing, 0 at k = 0."""
    k, phi = F.col("k"), scalar.direction(F.col("kx"), F.col("ky"))
    power = epsf * (1 + alpf * F.cos(2 * phi)) * k * F.exp(-0.5 * (k - kf) ** 2 / sigf**2) / (math.sqrt(2 * math.pi) * sigf)
    return wave_grid(spark, n).select("ki", "kj", F.when(k == 0, 0.0).otherwise(power).alias("power"))
