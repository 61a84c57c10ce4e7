"""Variational analysis of snapshots with sensors, by conjugate gradients in the space of their observations.

The minimum of half the squared distance to a background, in the metric of a stationary covariance B, plus half the squared misfit
over the error variance R, is x_b + B H' w with (H B H' + R) w = y - H x_b. A snapshot's system has a row for each of its sensors and
stands in the snapshot's row, so the steps are a fold over a column: no shuffle, no Python, and nothing of a grid's square. A third
term, the distance to another estimate in a stationary metric, makes with the first one distance to a field between both.
Rows without a background, sensors or observations have no analysis (null).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.batch import map_fields

EPS = 1e-8  # a spectrum's least value, as a share of its largest


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _plus(a: Column, factor: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + factor * y)


def _times(rows: Column, x: Column) -> Column:
    return F.transform(rows, lambda row: _dot(row, x))


def kernels(spark: SparkSession, spectra: dict[int, np.ndarray]) -> DataFrame:
    """n and kernel, a covariance's values at the offsets (i, j) of a periodic grid of n by n: a row for each size of grid."""
    rows = [(n, np.fft.ifft2(s + EPS * s.max()).real.ravel().tolist()) for n, s in spectra.items()]
    return spark.createDataFrame(rows, "n int, kernel array<double>")


def between(rows: DataFrame, spectrum_b: np.ndarray, spectrum_v: np.ndarray, x_b: str = "x_b", x_v: str = "x_v", name: str = "x_m") -> DataFrame:
    """Adds ``name``, the field of which the distances to ``x_b`` and ``x_v`` in their metrics are, but for a constant, one distance, in the metric of ``combined``."""
    wb, wv = (1 / (s + EPS * s.max()) for s in (spectrum_b, spectrum_v))

    def compute(n: int, b: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        return (np.fft.ifft2((wb * np.fft.fft2(b) + wv * np.fft.fft2(v)) / (wb + wv)).real,)

    return map_fields(rows, [x_b, x_v], {name: "array"}, compute)


def combined(spectrum_b: np.ndarray, spectrum_v: np.ndarray) -> np.ndarray:
    """The spectrum, without the least value that ``kernels`` adds, of the metric that two stationary ones add up to."""
    both = 1 / sum(1 / (s + EPS * s.max()) for s in (spectrum_b, spectrum_v))
    return both - both.max() * EPS / (1 + EPS)


def _folded(matrix: Column, miss: Column, variance: float, rounds: Column, tolerance: float) -> Column:
    """w, and cost, the objective before the first and after each step, of the conjugate gradients that begin at w = 0.

    aw carries the matrix times w, so that a cost takes no product of its own. A solved system stands still and has no further costs.
    """
    r0 = F.lit(variance)
    bound = tolerance**2

    def objective(w: Column, aw: Column) -> Column:
        return 0.5 * _dot(w, aw) + 0.5 * F.aggregate(F.zip_with(miss, aw, lambda y, h: (y - h) * (y - h)), F.lit(0.0), lambda s, x: s + x) / r0

    def state(w: Column, aw: Column, r: Column, d: Column, rr: Column, cost: Column) -> Column:
        return F.struct(w.alias("w"), aw.alias("aw"), r.alias("r"), d.alias("d"), rr.alias("rr"), cost.alias("cost"))

    def moved(s: Column, ad: Column) -> Column:
        def after(length: Column) -> Column:
            w, aw = _plus(s["w"], length, s["d"]), _plus(s["aw"], length, ad)
            r = F.zip_with(F.zip_with(s["r"], ad, lambda x, y: x - length * y), s["d"], lambda x, y: x - length * r0 * y)
            return _let(F.struct(w.alias("w"), aw.alias("aw"), r.alias("r")), lambda m: _let(_dot(m["r"], m["r"]), lambda rr: state(m["w"], m["aw"], m["r"], _plus(m["r"], rr / s["rr"], s["d"]), rr, F.concat(s["cost"], F.array(objective(m["w"], m["aw"]))))))

        return _let(s["rr"] / (_dot(s["d"], ad) + r0 * _dot(s["d"], s["d"])), after)

    def step(s: Column, _: Column) -> Column:
        return F.when(s["rr"] > bound * _dot(miss, miss), _let(_times(matrix, s["d"]), lambda ad: moved(s, ad))).otherwise(s)

    zero = F.transform(miss, lambda x: F.lit(0.0))
    start = state(zero, zero, miss, miss, _dot(miss, miss), F.array(objective(zero, zero)))
    return F.aggregate(F.sequence(F.lit(1), rounds), start, step)


def analysed(rows: DataFrame, kernel: DataFrame, std_o: float, x_b: str = "x_b", name: str = "x_a", tolerance: float = 1e-10) -> DataFrame:
    """``rows`` (n, ``x_b``, si, sj, y) with ``name``, its weights ``name``_w and costs ``name``_cost; ``kernel`` as ``kernels`` gives.

    At most twice as many steps as sensors, which in exact arithmetic are enough by half.
    """
    variance = std_o**2 + 1e-12
    met = rows.join(F.broadcast(kernel), "n", "left")  # a row for each size of grid
    n = F.col("n")
    near = lambda a, b: F.pmod(a - b, n)
    sensors = F.zip_with("si", "sj", lambda i, j: F.struct(i.alias("i"), j.alias("j")))
    value = lambda i, j: F.get("kernel", near(i[0], i[1]) * n + near(j[0], j[1]))
    matrix = F.transform("_s", lambda a: F.transform("_s", lambda b: value((a["i"], b["i"]), (a["j"], b["j"]))))
    miss = F.zip_with("_s", "y", lambda s, y: y - F.get(x_b, s["i"] * n + s["j"]))
    whole = (F.col(x_b).isNotNull()) & (F.size("_s") > 0) & (F.size("_s") == F.size("y")) & ~F.exists("_d", lambda x: x.isNull() | F.isnan(x))
    placed = met.withColumn("_s", sensors).withColumn("_d", miss).withColumn("_a", F.when(whole, matrix))
    solved = placed.withColumn("_f", F.when(whole, _folded(F.col("_a"), F.col("_d"), variance, 2 * F.size("_d"), tolerance)))
    weighted = F.zip_with("_s", "_f.w", lambda s, w: F.struct(s["i"].alias("i"), s["j"].alias("j"), w.alias("w")))

    def moved(x: Column, p: Column) -> Column:
        i, j = F.floor(p / n), p % n
        return F.aggregate("_w", x, lambda s, w: s + w["w"] * value((i, w["i"]), (j, w["j"])))

    found = solved.withColumn("_w", weighted).withColumn(name, F.when(whole, F.transform(x_b, moved)))
    return found.select(*rows.columns, name, F.col("_f.w").alias(f"{name}_w"), F.col("_f.cost").alias(f"{name}_cost"))
