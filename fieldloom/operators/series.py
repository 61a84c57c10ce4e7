"""Irregular and regular series: numbering, resampling, cadence, strides, autocorrelation, lookups.

Times are epoch microseconds or whole steps, so that ticks are exact. A run may hold most of all rows, so
none is ordered as a whole: its axis is cut into buckets, rows are ordered within a bucket, and what a
bucket must know of those before it comes from a table with a row for each bucket. Rows without a time or
position take no part in ``resampled``; keys may be null.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import scalar

BUCKET = 1 << 14  # steps or ticks of a bucket


def beside(rows: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``per``, which has a row for each of ``keys``; nulls are equal."""
    same = reduce(and_, [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys])
    return rows.alias("r").join(per.alias("p"), same).select("r.*", *[F.col(f"p.{c}") for c in per.columns if c not in keys])


def numbered(rows: DataFrame, keys: list[str], order: list[str], width: float = BUCKET, few: bool = False) -> DataFrame:
    """``rows`` with position, from 0, in ``order`` within ``keys``, and total, the rows of those keys.

    The first of ``order`` is a number, cut into buckets of ``width``. Where keys and buckets are ``few``, what is known of each is broadcast,
    so that rows are shuffled once, and come in order of the keys' buckets.
    """
    bucketed = rows.withColumn("_bucket", F.floor(F.col(order[0]) / width))
    whole = Window.partitionBy(*keys)
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_here"))
    starts = counts.select(*keys, "_bucket", (F.sum("_here").over(whole.orderBy("_bucket")) - F.col("_here")).alias("_start"), F.sum("_here").over(whole).alias("total"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    placed = beside(bucketed.withColumn("_at", within), F.broadcast(starts) if few else starts, [*keys, "_bucket"])
    return placed.withColumn("position", F.col("_at") + F.col("_start")).drop("_bucket", "_at", "_start")


def preceded(rows: DataFrame, keys: list[str], order: str, column: str, name: str, width: float = BUCKET) -> DataFrame:
    """``rows`` with ``name``, the value of ``column`` in the row before within ``keys``; ``order`` is a number, cut into buckets of ``width``."""
    bucketed = rows.withColumn("_bucket", F.floor(F.col(order) / width))
    ends = bucketed.groupBy(*keys, "_bucket").agg(F.max_by(column, order).alias("_end"))
    ends = ends.select(*keys, "_bucket", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_before"))
    here = F.lag(column).over(Window.partitionBy(*keys, "_bucket").orderBy(order))
    return beside(bucketed.withColumn("_here", here), ends, [*keys, "_bucket"]).withColumn(name, F.coalesce("_here", "_before")).drop("_bucket", "_here", "_before")


def resampled(series: DataFrame, step: int, bucket: int = BUCKET) -> DataFrame:
    """run, us, v at every multiple of ``step`` within each run's span, by linear interpolation.

    A tick belongs to the interval that ends at or after it; a tick at the run's first sample takes that sample.
    No range join: an interval lists its own ticks.
    """
    bucketed = series.where("us is not null").withColumn("_bucket", F.floor(F.col("us") / (step * bucket)))
    ends = bucketed.groupBy("run", "_bucket").agg(F.max(F.struct("us", "id", "v")).alias("_end"))
    before = ends.select("run", "_bucket", F.lag("_end").over(Window.partitionBy("run").orderBy("_bucket")).alias("_before"))
    last = F.lag(F.struct("us", "v")).over(Window.partitionBy("run", "_bucket").orderBy("us", "id"))
    pairs = beside(bucketed.withColumn("_last", last), before, ["run", "_bucket"])
    last = F.coalesce("_last", F.when(F.col("_before").isNotNull(), F.struct("_before.us", "_before.v")))
    pairs = pairs.withColumn("_last", last).select("run", "us", "v", F.col("_last.us").alias("us0"), F.col("_last.v").alias("v0"))
    return ticks(pairs, step)


def ticks(pairs: DataFrame, step: int) -> DataFrame:
    """run, us, v at the multiples of ``step`` after us0 up to us; us0 is null at a run's first sample."""
    first = F.col("us0").isNull()
    # Ticks t with us0 < t <= us; the first sample has only itself.
    low = F.when(first, F.ceil(F.col("us") / step)).otherwise(F.floor(F.col("us0") / step) + 1)
    high = F.floor(F.col("us") / step)
    found = pairs.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("tick", F.explode(F.sequence("low", "high")))
    at = F.col("tick") * step
    alpha = (at - F.col("us0")) / (F.col("us") - F.col("us0"))
    value = F.when(first | (F.col("us") == F.col("us0")), F.col("v")).otherwise((1 - alpha) * F.col("v0") + alpha * F.col("v"))
    return found.select("run", at.alias("us"), value.alias("v"))


def first_tick(series: DataFrame, spinup: int, step: int) -> DataFrame:
    """run and the first multiple of ``step`` at or after the first sample later than ``spinup``."""
    return series.where(F.col("us") > spinup).groupBy("run").agg((F.ceil(F.min("us") / step) * step).alias("tick"))


def cadence(series: DataFrame, step: int) -> DataFrame:
    """run, us, v: the first sample in each interval of ``step``, for series whose steps are shorter than it."""
    slots = series.groupBy("run", F.floor(F.col("us") / step).alias("slot")).agg(F.min(F.struct("us", "id", "v")).alias("x"))
    return slots.select("run", "slot", "x.us", "x.v")


def least_before(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str, width: float = BUCKET) -> DataFrame:
    """``rows`` with ``name``, the least ``column`` of the rows before within ``keys`` (null at the first); the first of ``order`` is a number, cut into buckets of ``width``."""
    bucketed = rows.withColumn("_bucket", F.floor(F.col(order[0]) / width))
    before = Window.unboundedPreceding, -1
    ends = bucketed.groupBy(*keys, "_bucket").agg(F.min(column).alias("_end"))
    ends = ends.select(*keys, "_bucket", F.min("_end").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*before)).alias("_earlier"))
    here = F.min(column).over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(*before))
    met = beside(bucketed.withColumn("_here", here), ends, [*keys, "_bucket"])
    return met.withColumn(name, F.least("_here", "_earlier")).drop("_bucket", "_here", "_earlier")  # passes over nulls


def cadence_with_lag(series: DataFrame, step: int, bucket: int = 3_600_000_000) -> DataFrame:
    """run, record, us, v, lag: the samples that a recorder keeps which takes a sample once its due time has come and then
    moves that time on by ``step``. It takes one a sample at most, so after a gap it lags behind and catches up; ``lag`` is how far.

    A run's first sample is due at its own time, the k-th record k steps later. With p the position of a sample and f the steps since
    the first that have begun by its time, records up to it are p + min(1, least f - p so far): a prefix minimum in place of the loop.
    """
    known = series.where("us is not null")
    starts = known.groupBy("run").agg(F.min("us").alias("_since"))
    placed = numbered(beside(known, starts, ["run"]), ["run"], ["us", "id"], bucket)
    ahead = F.floor((F.col("us") - F.col("_since")) / step) + 1 - F.col("position")
    met = least_before(placed.withColumn("_ahead", ahead), ["run"], ["us", "id"], "_ahead", "_before", bucket)
    low = F.least(F.lit(1), F.col("_before"))
    kept = met.withColumn("record", F.col("position") + low - 1).where(F.col("_ahead") >= low)
    return kept.select("run", "record", "us", "v", (F.col("us") - F.col("_since") - F.col("record") * step).alias("lag"))


def step_size(series: DataFrame, bucket: int = 3_600_000_000) -> DataFrame:
    """run and dt, the second time less the first."""
    placed = numbered(series.select("run", "us", "id"), ["run"], ["us", "id"], bucket).where("position < 2")
    return placed.groupBy("run").agg((F.max("us") - F.min("us")).alias("dt"))


def strided(rows: DataFrame, stride: int, *order: str, bucket: float = BUCKET) -> DataFrame:
    """Every ``stride``-th row of each run, the first included, and its position."""
    return numbered(rows, ["run"], list(order), bucket).drop("total").where(F.col("position") % stride == 0)


def evenly(rows: DataFrame, most: int, *order: str, bucket: float = BUCKET) -> DataFrame:
    """At most ``most`` rows of each run, evenly spaced in order, both ends included, positions rounded down."""
    placed = numbered(rows, ["run"], list(order), bucket)
    # Row p is wanted if some m < most has floor(m (n - 1) / (most - 1)) = p; every row is if there are no more than ``most``.
    m = F.ceil(F.col("position") * (most - 1) / F.greatest(F.col("total") - 1, F.lit(1)))
    hit = (F.floor(m * (F.col("total") - 1) / (most - 1)) == F.col("position")) & (m < most)
    return placed.where(hit | (F.col("total") <= most)).drop("total")


def full_autocorrelation(series: DataFrame, keys: list[str], tile: int = 16) -> DataFrame:
    """keys, lag, acf: real part of the demeaned complex series' autocorrelation at every lag from 1 to the last position less the first, 1 at lag 0.

    ``series`` has keys, re, im and pos (whole; what is missing counts as the mean). The lags are the inverse transform of the power spectrum of a run, padded to
    m = n1 n2 places, a power of two at least twice its span. Both transforms are dealt out in four steps: position p1 + n1 p2 is in
    column p1; columns are transformed, turned by their twiddle factors, and shuffled into rows k2, which give wavenumbers k2 + n2 k1; the rows' powers
    go back the same way. A group has ``tile`` columns or rows of some sqrt(m) numbers each, and every number is shuffled three times, however long a run is.
    """
    means = series.groupBy(*keys).agg(F.avg("re").alias("_re"), F.avg("im").alias("_im"), F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    span = (F.col("_last") - F.col("_first")).cast("long")
    bits = F.ceil(F.log2(2.0 * (span + 1))).cast("int")
    means = means.withColumn("_most", span).withColumn("_n1", F.pow(F.lit(2.0), F.floor(bits / 2)).cast("int")).withColumn("_n2", F.pow(F.lit(2.0), bits - F.floor(bits / 2)).cast("int"))
    parts = [F.coalesce(F.col(c) - F.col(f"_{c}"), F.lit(0.0)).alias(c) for c in ("re", "im")]
    placed = beside(series, means, keys).select(*keys, "_most", "_n1", "_n2", (F.col("pos") - F.col("_first")).alias("_p"), *parts)
    kinds = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys)
    numbers = "_most long, _n1 int, _n2 int"

    def read(group: pa.Table) -> tuple[int, int, int]:
        return group["_tile"][0].as_py(), group["_n1"][0].as_py(), group["_n2"][0].as_py()

    def same(group: pa.Table, rows: int) -> dict[str, pa.Array]:
        """The keys and numbers of a group, for so many rows."""
        return {c: pa.chunked_array([group[c].combine_chunks().take(pa.array(np.zeros(rows, np.int64)))]) for c in [*keys, "_most", "_n1", "_n2"]}

    def dealt(group: pa.Table, at: int, z: np.ndarray) -> pa.Table:
        """``z``, whose columns from ``at`` on have been transformed, in tiles of rows."""
        starts = np.arange(0, len(z), tile)
        flat = [z[a : a + tile].ravel() for a in starts]
        return pa.table(same(group, len(starts)) | {"_tile": pa.array(starts // tile), "_at": pa.array(np.full(len(starts), at)), "re": pa.array([x.real for x in flat], pa.list_(pa.float64())), "im": pa.array([x.imag for x in flat], pa.list_(pa.float64()))})

    def gathered(group: pa.Table, here: int, across: int) -> np.ndarray:
        """The rows of a tile, ``across`` wide, from the pieces that columns sent."""
        z = np.empty((here, across), complex)
        for at, re, im in zip(group["_at"].to_pylist(), group["re"], group["im"], strict=True):
            piece = (re.values.to_numpy() + 1j * im.values.to_numpy()).reshape(here, -1)
            z[:, at : at + piece.shape[1]] = piece
        return z

    def columns(group: pa.Table) -> pa.Table:
        number, n1, n2 = read(group)
        own = np.arange(number * tile, min(n1, (number + 1) * tile))
        z = np.zeros((n2, len(own)), complex)
        p = group["_p"].to_numpy()
        np.add.at(z, (p // n1, p % n1 - own[0]), group["re"].to_numpy() + 1j * group["im"].to_numpy())
        z = np.fft.fft(z, axis=0) * np.exp(-2j * np.pi * (np.arange(n2)[:, None] * own % (n1 * n2)) / (n1 * n2))
        return dealt(group, int(own[0]), z)

    def rows(group: pa.Table) -> pa.Table:
        number, n1, n2 = read(group)
        own = np.arange(number * tile, min(n2, (number + 1) * tile))
        power = np.abs(np.fft.fft(gathered(group, len(own), n1), axis=1)) ** 2
        z = np.fft.ifft(power, axis=1).T * np.exp(2j * np.pi * (np.arange(n1)[:, None] * own % (n1 * n2)) / (n1 * n2))
        return dealt(group, int(own[0]), z)

    def lags(group: pa.Table) -> pa.Table:
        number, n1, n2 = read(group)
        own = np.arange(number * tile, min(n1, (number + 1) * tile))
        sums = np.fft.ifft(gathered(group, len(own), n2), axis=1).real
        lag = own[:, None] + n1 * np.arange(n2)
        use = (lag >= 1) & (lag <= group["_most"][0].as_py())
        return pa.table({k: v for k, v in same(group, int(use.sum())).items() if k in keys} | {"lag": pa.array(lag[use].astype(np.int64)), "s": pa.array(sums[use])})

    packed = f"{kinds}, {numbers}, _tile long, _at long, re array<double>, im array<double>"
    by_tile = [*keys, "_tile"]
    first = placed.withColumn("_tile", F.floor(F.col("_p") % F.col("_n1") / tile))
    found = first.groupBy(*by_tile).applyInArrow(columns, packed).groupBy(*by_tile).applyInArrow(rows, packed).groupBy(*by_tile).applyInArrow(lags, f"{kinds}, lag long, s double")
    whole = placed.groupBy(*keys).agg(F.sum(scalar.abs2(F.col("re"), F.col("im"))).alias("_s0"))
    return beside(found, whole, keys).select(*keys, "lag", F.when(F.col("_s0") > 0, F.col("s") / F.col("_s0")).alias("acf"))


def cumulative(lengths: DataFrame) -> DataFrame:
    """run, length, low and high: each run's half-open range of positions in the pool of all. A row for each run."""
    high = F.sum("length").over(Window.orderBy("run"))
    return lengths.withColumn("high", high).withColumn("low", F.col("high") - F.col("length"))


def located(positions: DataFrame, ranges: DataFrame, block: int = BUCKET) -> DataFrame:
    """position, run and local: where in which run each position of the pool lies. Both sides meet by block of positions; a range lists the blocks it reaches into."""
    reach = F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))
    listed = ranges.where("low < high").withColumn("_block", F.explode(reach))
    joined = positions.withColumn("_block", F.floor(F.col("position") / block)).join(listed, "_block").where("position >= low and position < high")
    return joined.select("position", "run", (F.col("position") - F.col("low")).alias("local"))


def coarsened(series: DataFrame, interval: int, bucket: int = 3_600_000_000) -> DataFrame:
    """run, position, us and v of every k-th sample of each run, k being the interval over the run's first step, rounded, and at least 1."""
    steps = step_size(series, bucket).withColumn("_stride", F.greatest(F.lit(1), F.round(interval / F.col("dt")).cast("long")))
    placed = numbered(series.select("run", "us", "id", "v"), ["run"], ["us", "id"], bucket)
    kept = beside(placed, steps.select("run", "_stride"), ["run"])
    return kept.where(F.col("position") % F.coalesce("_stride", F.lit(1)) == 0).select("run", "position", "us", "v")


def intersected(a: DataFrame, b: DataFrame, value: str, width: float = BUCKET) -> DataFrame:
    """value, at_a and at_b: values that both tables have, and where each has its first one, counted from 1 in order of value."""
    place = lambda rows, name: numbered(rows.select(value), [], [value], width).groupBy(value).agg((F.min("position") + 1).alias(name))
    return place(a, "at_a").join(place(b, "at_b"), value)


def controlled_steps(errors: Column, first_step: float, tolerance: float = 0.1) -> Column:
    """Step sizes after each of an array of error estimates: PI control, and three quarters after a rejection."""
    start = F.struct(F.lit(0.8 * tolerance).alias("before"), F.lit(first_step).alias("dt"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(state: Column, r: Column) -> Column:
        grown = F.pow(0.75 * tolerance / r, F.lit(0.3 / 4)) * F.pow(state["before"] / r, F.lit(0.4 / 4)) * state["dt"]
        dt = F.when(r > tolerance, 0.75 * state["dt"]).otherwise(grown)
        return F.struct(F.when(r > tolerance, state["before"]).otherwise(r).alias("before"), dt.alias("dt"), F.concat(state["out"], F.array(dt)).alias("out"))

    return F.aggregate(errors, start, step, lambda s: s["out"])


def step_sizes(errors: DataFrame, first_step: float, tolerance: float = 0.1, block: int = BUCKET) -> DataFrame:
    """run, position and dt: ``controlled_steps`` over whole runs, with no array of a run.

    ``errors`` has run, position (whole, from 0) and r, positive. The last accepted error before a row, and the running sum of the
    logarithms of the factors, come from its block of positions and from a table with a row for each block.
    """
    rows = errors.select("run", "position", "r", F.floor(F.col("position") / block).alias("_block"), F.when(F.col("r") <= tolerance, F.col("r")).alias("_kept"))
    earlier = Window.partitionBy("run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("run", "_block").orderBy("position")
    ends = rows.groupBy("run", "_block").agg(F.max(F.when(F.col("_kept").isNotNull(), F.struct("position", "_kept"))).alias("_end"))
    ends = ends.select("run", "_block", F.last("_end._kept", ignorenulls=True).over(earlier).alias("_before"))
    here = F.last("_kept", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    met = beside(rows.withColumn("_here", here), ends, ["run", "_block"])
    before = F.coalesce("_here", "_before", F.lit(0.8 * tolerance))
    grown = 0.3 / 4 * F.log(0.75 * tolerance / F.col("r")) + 0.4 / 4 * F.log(before / F.col("r"))
    met = met.withColumn("_log", F.when(F.col("r") > tolerance, F.log(F.lit(0.75))).otherwise(grown))
    sums = met.groupBy("run", "_block").agg(F.sum("_log").alias("_sum"))
    starts = sums.select("run", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_start"))
    summed = met.withColumn("_run_sum", F.sum("_log").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return beside(summed, starts, ["run", "_block"]).select("run", "position", (first_step * F.exp(F.col("_start") + F.col("_run_sum"))).alias("dt"))
