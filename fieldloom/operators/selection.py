"""Choosing rows: seeded samples and splits of exact counts, mini-batches, guards, set operations, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalar import uniform
from fieldloom.operators.series import numbered


def sample(rows: DataFrame, k: int, seed: int, *ids: str) -> DataFrame:
    """k rows without replacement, those of the least seeded hash; ``limit`` keeps each task's k best only."""
    return rows.withColumn("_u", uniform(*[F.col(c) for c in ids], F.lit(seed))).orderBy("_u", *ids).limit(k).drop("_u")


def train_val_split(rows: DataFrame, share: float, seed: int, *ids: str, bins: int = 1 << 16) -> DataFrame:
    """``rows`` with part, 'val' for exactly max(1, share of the count, halves to even) of them.

    The border is the hash of the last row that belongs to the validation part: hashes are counted in ``bins``, and only
    those of the bin with the border are sorted. Every row is then compared with it; only rows at the border itself, more than one
    where rows are repeated, are numbered.
    """
    hashed = rows.withColumn("_u", uniform(*[F.col(c) for c in ids], F.lit(seed)))
    placed = hashed.select("_u", F.floor(F.col("_u") * bins).alias("_bin"))
    counts = {r[0]: r[1] for r in placed.groupBy("_bin").count().collect()}  # a row for each bin
    left, at = max(1, round(share * sum(counts.values()))), -1
    for at in sorted(counts):
        if left <= counts[at]:
            break
        left -= counts[at]
    border = placed.where(F.col("_bin") == at).select("_u").orderBy("_u").limit(left).groupBy(F.col("_u").alias("_border")).agg(F.count("*").alias("_some")).orderBy(F.desc("_border")).limit(1)
    met = hashed.crossJoin(F.broadcast(border))  # one row
    nth = F.row_number().over(Window.partitionBy("_u").orderBy(*ids))
    there = met.where("_u = _border").withColumn("part", F.when(nth <= F.col("_some"), "val").otherwise("train"))
    rest = met.where("_u <> _border").withColumn("part", F.when(F.col("_u") < F.col("_border"), "val").otherwise("train"))
    return rest.unionByName(there).drop("_u", "_border", "_some")


def minibatches(rows: DataFrame, size: int, seed: int, epoch: int, keys: list[str], *ids: str, bins: int = 1024) -> DataFrame:
    """``rows`` with batch: shuffled anew each epoch within ``keys`` and cut into runs of ``size``."""
    return in_batches(rows, size, seed, epoch, keys, *ids, bins=bins).drop("place")


def in_batches(rows: DataFrame, size: int, seed: int, epoch: int, keys: list[str], *ids: str, bins: int = 1024) -> DataFrame:
    """The same with place, from 0, in the batch. Without ``keys`` rows are shuffled once, into ``bins`` groups about alike in size, and lie in order in their group."""
    shuffled = rows.withColumn("_u", uniform(*[F.col(c) for c in ids], F.lit(seed), F.lit(epoch)))
    placed = numbered(shuffled, keys, ["_u", *ids], 1 / bins, few=not keys)
    return placed.withColumn("batch", F.floor(F.col("position") / size)).withColumn("place", F.col("position") % size).drop("_u", "position", "total")


def guard(packed: DataFrame, limit: float = 1.5e5, column: str = "field") -> DataFrame:
    """run, t, has_nan, too_large and stop for each field."""
    nan = F.exists(column, F.isnan)
    large = F.exists(column, lambda x: ~F.isnan(x) & (F.abs(x) > limit))
    return packed.select("run", "t", nan.alias("has_nan"), large.alias("too_large"), (nan | large).alias("stop"))


def matched_lengths(times: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots that have a time and times that have a snapshot, joined by run and position."""
    return times.join(snapshots, ["run", "position"])


def with_artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Runs of the manifest that have an artifact."""
    return manifest.join(files, "run", "left_semi")


def without_artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files, "run", "left_anti")


def first_where(keys: list[str], rows: DataFrame, position: str, condition: Column) -> DataFrame:
    """The first position at which a condition holds, null if nowhere."""
    return rows.groupBy(*keys).agg(F.min(F.when(condition, F.col(position))).alias("first"))
