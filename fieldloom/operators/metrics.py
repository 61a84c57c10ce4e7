"""Scores of estimates against truth: relative error, structural similarity, summaries, win rates, verdict.

A pair of fields is one row, so each score is computed where the row lies.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.batch import map_fields
from fieldloom.operators.series import BUCKET, beside, numbered
from fieldloom.sources.tables import total


def relative_rmse(estimate: str = "x_est", truth: str = "x_true") -> Column:
    """Norm of the error over the norm of the truth; null for a truth of zeros."""
    error = F.sqrt(total(F.zip_with(estimate, truth, lambda a, b: (a - b) * (a - b))))
    norm = F.sqrt(total(F.transform(truth, lambda x: x * x)))
    return F.when(norm > 0, error / norm)


def field_range(column: str) -> Column:
    return F.array_max(column) - F.array_min(column)


def shared_scale(*columns: str) -> tuple[Column, Column]:
    """Least and greatest value over several fields."""
    return F.least(*[F.array_min(c) for c in columns]), F.greatest(*[F.array_max(c) for c in columns])


def symmetric_scale(truth: str, *columns: str) -> Column:
    """Largest absolute error of several fields against one."""
    return F.greatest(*[F.array_max(F.zip_with(c, truth, lambda a, b: F.abs(a - b))) for c in columns])


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    """Sums over all size by size windows of (rows, n, n)."""
    s = np.pad(x.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    return s[:, size:, size:] - s[:, :-size, size:] - s[:, size:, :-size] + s[:, :-size, :-size]


def ssim(pairs: DataFrame, estimate: str = "x_est", truth: str = "x_true", window: int = 7) -> DataFrame:
    """``pairs`` with ssim: mean over all whole windows, sample covariances, constants 0.01 and 0.03 of the truth's range."""

    def compute(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        count = window * window
        span = (y.max((1, 2)) - y.min((1, 2)))[:, None, None]
        c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
        mx, my = _windows(x, window) / count, _windows(y, window) / count
        norm = count / (count - 1)
        vx, vy, vxy = (norm * (_windows(a * b, window) / count - ma * mb) for a, b, ma, mb in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
        return ((((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean((1, 2)),)

    return map_fields(pairs, [estimate, truth], {"ssim": "double"}, compute)


def summary(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, least and greatest by keys."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def quartiles(scores: DataFrame, keys: list[str], value: str, bins: int = 4096) -> DataFrame:
    """keys, q1, median and q3, exact, between neighbours by linear interpolation.

    Values are counted in bins of equal width and numbered within a bin, so that no key's values meet in one task.
    """
    there = scores.where(F.col(value).isNotNull())
    low, high = there.agg(F.min(value), F.max(value)).first()
    width = (high - low) / bins if low is not None and high > low else 1.0
    placed = numbered(there.select(*keys, value), keys, [value], width)

    def at(share: float) -> Column:
        place = (F.col("total") - 1) * share
        below, rest = F.floor(place), place - F.floor(place)
        part = F.when(F.col("position") == below, F.col(value) * (1 - rest)).when((F.col("position") == below + 1) & (rest > 0), F.col(value) * rest)
        return F.sum(part)

    return placed.groupBy(*keys).agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))


def box(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, and the least and greatest value within 1.5 interquartile ranges of them."""
    q = quartiles(scores, keys, value)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return scores.join(q, keys).groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))


def win_rate(wide: DataFrame, a: str, b: str) -> DataFrame:
    """How often a is below b, and the share."""
    won = (F.col(a) < F.col(b)).cast("int")
    return wide.agg(F.sum(won).cast("long").alias("wins"), F.avg(won).alias("rate"), F.count("*").alias("n"))


def verdict(wide: DataFrame, background: str, inverse: str, three_term: str, near: float = 0.05) -> DataFrame:
    """Shares of snapshots where the inverse operator loses to the background, and where the analysis stays near it; what they point at."""
    shares = wide.agg(F.avg((F.col(inverse) > F.col(background)).cast("int")).alias("worse"), F.avg((F.abs(F.col(inverse) - F.col(three_term)) < near).cast("int")).alias("close"))
    blame = F.when(F.col("worse") > 0.5, "network").when(F.col("close") > 0, "over-trust").otherwise("combination")
    return shares.withColumn("verdict", blame)


def weighted_loss(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of loss weighted by batch size n."""
    return batches.groupBy(*keys).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def running_best(losses: DataFrame, keys: list[str], order: str, width: float = BUCKET) -> DataFrame:
    """The least loss so far and whether the row improves on all before it; ``order`` is a number, cut into buckets of ``width``."""
    bucketed = losses.withColumn("_bucket", F.floor(F.col(order) / width))
    least = bucketed.groupBy(*keys, "_bucket").agg(F.min("loss").alias("_least"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(*keys, "_bucket", F.min("_least").over(earlier).alias("_earlier"))
    here = F.min("loss").over(Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    met = beside(bucketed.withColumn("_here", here), least, [*keys, "_bucket"])
    before = F.least("_here", "_earlier")  # passes over nulls
    return met.withColumn("best", F.least("loss", before)).withColumn("improved", F.coalesce(F.col("loss") < before, F.lit(True))).drop("_bucket", "_here", "_earlier")
