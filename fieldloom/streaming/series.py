"""The series operators on streams: resampling, cadence, running moments, late data.

All are watermarked aggregates. ``closed`` fills a sink with whole buckets of samples, and ``resampled`` reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.series import ticks


def closed(stream: DataFrame, step: int, lateness: str = "10 minutes", bucket: int = 24) -> DataFrame:
    """run and x, the samples in order, of each bucket of ``bucket`` steps that the watermark has passed; (run, us, id, v) in.

    Until then rows wait in their run's bucket, so they may come in any order within ``lateness``; later ones the watermark drops.
    """
    timed = stream.withColumn("_ts", F.timestamp_micros("us")).withWatermark("_ts", lateness)
    buckets = timed.groupBy("run", F.window("_ts", f"{step * bucket} microseconds").alias("w"))
    return buckets.agg(F.array_sort(F.collect_list(F.struct("us", "id", "v"))).alias("x")).select("run", "x")


def resampled(buckets: DataFrame, step: int) -> DataFrame:
    """run, us, v at multiples of ``step``, as ``operators.series.resampled`` gives for the whole, of what ``closed`` has put in its sink so far.

    Only the first and the last sample of a bucket meet those of its run's other buckets.
    """
    near = F.expr("zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x) - 1), (a, b) -> struct(b.us, b.v, a.us as us0, a.v as v0))")
    ends = buckets.select("run", F.col("x")[0].alias("a"), F.element_at("x", -1).alias("b"))
    ends = ends.withColumn("b", F.lag("b").over(Window.partitionBy("run").orderBy("a.us")))  # a row for each bucket
    pairs = buckets.select("run", F.explode(near).alias("p")).select("run", "p.*")
    return ticks(pairs.unionByName(ends.select("run", "a.us", "a.v", F.col("b.us").alias("us0"), F.col("b.v").alias("v0"))), step)


def cadence(stream: DataFrame, step: str, lateness: str = "10 minutes") -> DataFrame:
    """run, slot, us, v: the first sample of each window of ``step``; ``stream`` has run, ts, us, v."""
    first = F.min(F.struct("us", "v")).alias("x")
    windows = stream.withWatermark("ts", lateness).groupBy("run", F.window("ts", step).alias("w")).agg(first)
    return windows.select("run", F.col("w.start").alias("slot"), "x.us", "x.v")


def moments(stream: DataFrame) -> DataFrame:
    """run, s1, s2, n_records: running sums over all that came."""
    return stream.groupBy("run").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.count("*").alias("n_records"))


def sliding(stream: DataFrame, width: str, slide: str, lateness: str = "10 minutes") -> DataFrame:
    """run, start, mean, n_records over sliding windows."""
    windows = stream.withWatermark("ts", lateness).groupBy("run", F.window("ts", width, slide).alias("w")).agg(F.avg("v").alias("mean"), F.count("*").alias("n_records"))
    return windows.select("run", F.col("w.start").alias("start"), "mean", "n_records")


def sessions(stream: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """run, start, end, n_records of samples closer than ``gap``."""
    found = stream.withWatermark("ts", lateness).groupBy("run", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_records"))
    return found.select("run", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_records")
