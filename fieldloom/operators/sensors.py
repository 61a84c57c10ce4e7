"""Sparse sensors: placement, sampling, nearest-sensor tessellation, the local sum-of-squares observation.

A snapshot's sensors are arrays beside its field, so sampling and tessellating stay in the row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import grids, scalar
from fieldloom.operators.batch import map_fields
from fieldloom.session import stored


def placed(fields: DataFrame, per_side: int, radius: float = 3.0, seed: int = 0) -> DataFrame:
    """Adds si and sj: a lattice of per_side^2 points, each moved within a disk, rounded half to even and clipped to the grid."""
    u = lambda sid, salt: scalar.uniform(F.col("run"), F.col("t"), sid, F.lit(seed), F.lit(salt))
    step = (F.col("n") - 1) / (per_side - 1 if per_side > 1 else 1)

    def coordinate(sid: Column, lattice: Column, turn) -> Column:
        moved = lattice * step + radius * F.sqrt(u(sid, 1)) * turn(2 * math.pi * u(sid, 0))
        return scalar.clip(F.rint(moved), 0.0, (F.col("n") - 1).cast("double")).cast("int")

    ids = F.sequence(F.lit(0), F.lit(per_side * per_side - 1))
    rows = F.transform(ids, lambda s: coordinate(s, F.floor(s / per_side), F.cos))
    columns = F.transform(ids, lambda s: coordinate(s, s % per_side, F.sin))
    return fields.withColumn("si", rows).withColumn("sj", columns)


def sampled(field: str = "field", si: str = "si", sj: str = "sj") -> Column:
    """Values of a field at its sensors; sensors that share a cell repeat its value."""
    return F.zip_with(si, sj, lambda i, j: F.get(field, i * F.col("n") + j))


def noisy(values: str, share: float, seed: int) -> Column:
    """Values plus ``share`` of their size times a seeded normal number."""

    def add(y: Column, i: Column) -> Column:
        u = lambda salt: scalar.uniform(F.col("run"), F.col("t"), i, F.lit(seed), F.lit(salt))
        normal = F.sqrt(-2 * F.ln(u(2))) * F.cos(2 * math.pi * u(3))
        return y + share * F.abs(y) * normal

    return F.transform(values, add)


def _tile_side(n: int, sensors: float) -> int:
    """Tiles of about one sensor each."""
    return max(1, math.isqrt(int(n * n / max(1.0, sensors))))


def nearest_sensor(n: int, field: np.ndarray, si: np.ndarray, sj: np.ndarray, fields: int) -> np.ndarray:
    """For each cell of ``fields`` grids the place, in ``field`` (sorted), ``si`` and ``sj``, of the nearest of its grid's sensors, the first of equals; -1 without any.

    Sensors lie in square tiles. Cells search the tiles around their own ring by ring, all of them at once, and are done when nothing
    farther out can be as near.
    """
    side = _tile_side(n, len(si) / max(1, fields))
    across = -(-n // side)
    tile = (field * across + si // side) * across + sj // side
    order = np.argsort(tile, kind="stable")
    starts = np.searchsorted(tile[order], np.arange(fields * across * across + 1))
    left, total = np.arange(fields * n * n), max(1, len(si))
    none = np.iinfo(np.int64).max
    best = np.full(len(left), none)  # distance squared, then place
    ring = 0
    while len(left) and ring <= across:
        grid, cell = np.divmod(left, n * n)
        i, j = np.divmod(cell, n)
        found = best[left]
        for x in range(-ring, ring + 1):
            for y in range(-ring, ring + 1) if abs(x) == ring else {-ring, ring}:
                row, column = i // side + x, j // side + y
                at = np.flatnonzero((row >= 0) & (row < across) & (column >= 0) & (column < across))
                here = (grid[at] * across + row[at]) * across + column[at]
                first, count = starts[here], starts[here + 1] - starts[here]
                for k in range(int(count.max(initial=0))):
                    some = count > k
                    s = order[first[some] + k]
                    c = at[some]
                    found[c] = np.minimum(found[c], ((i[c] - si[s]) ** 2 + (j[c] - sj[s]) ** 2) * total + s)
        best[left] = found
        # What lies in no tile of these rings is at least this far away.
        edge = np.minimum(np.minimum(i % side, side - 1 - i % side), np.minimum(j % side, side - 1 - j % side)) + ring * side + 1
        left = left[(found == none) | (found // total >= edge**2)]
        ring += 1
    return np.where(best == none, -1, best % total).reshape(fields, n * n)


def tessellated(observed: DataFrame, values: str = "y") -> DataFrame:
    """``observed`` with cell_sensor and cell_value: for each cell the nearest sensor (Euclidean, not periodic; ties to the lowest number) and its value; null without sensors."""
    schema = T.StructType([*observed.schema.fields, T.StructField("cell_sensor", T.ArrayType(T.IntegerType())), T.StructField("cell_value", T.ArrayType(T.DoubleType()))])
    names = observed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column(names.index("n")).to_numpy()
            for n in map(int, np.unique(sizes)):
                same = whole.filter(pa.array(sizes == n)) if (sizes != n).any() else whole
                step = max(1, (1 << 16) // (n * n))
                for a in range(0, same.num_rows, step):
                    b = same.slice(a, step)
                    si, sj, y = (b.column(names.index(c)) for c in ("si", "sj", values))
                    counts = np.asarray(si.value_lengths().fill_null(0))
                    field = np.repeat(np.arange(b.num_rows), counts)
                    i, j = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (si, sj))
                    nearest = nearest_sensor(n, field, i, j, b.num_rows)
                    number = pa.array((nearest - (np.cumsum(counts) - counts)[:, None]).ravel().astype(np.int32), mask=nearest.ravel() < 0)
                    value = y.flatten().cast(pa.float64()).take(pa.array(nearest.ravel(), mask=nearest.ravel() < 0))
                    ends = np.arange(b.num_rows + 1, dtype=np.int32) * (n * n)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, number), pa.ListArray.from_arrays(ends, value)], [*names, "cell_sensor", "cell_value"])

    return observed.mapInArrow(run, schema)


def tessellated_cells(sensors: DataFrame, n: int) -> DataFrame:
    """run, t, i, j, sid, v of sensor rows run, t, sid, si, sj, y: every cell of each snapshot with its nearest sensor, by joins.

    Tiles have about one sensor each. A cell meets the sensors of the tiles in one ring after the other around its own; what no sensor of a
    farther ring can change is settled, and only the others go on. A ring is stored before the next. Sensors are as many as the snapshots times their
    sensors, which Spark's estimates don't see after an explode, so they meet cells by shuffle and are never collected for a broadcast.
    """
    spark, keys = sensors.sparkSession, ["run", "t"]
    snapshots = sensors.groupBy(*keys).agg(F.count("*").alias("_sensors"))
    side = _tile_side(n, snapshots.agg(F.avg("_sensors")).first()[0] or 1)
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    cells = snapshots.select(*keys, F.explode(numbers).alias("i")).select(*keys, "i", F.explode(numbers).alias("j"))
    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    dealt = stored(sensors.select(*keys, tile("si").alias("x"), tile("sj").alias("y"), "si", "sj", "sid", F.col("y").alias("v")))
    left, settled, ring = cells.withColumn("s", F.lit(None).cast("struct<d2:bigint,sid:int,v:double>")), None, 0
    while True:
        around = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(-ring, ring + 1) for y in range(-ring, ring + 1) if max(abs(x), abs(y)) == ring]
        asked = left.select(*keys, "i", "j", F.explode(F.array(*around)).alias("o")).select(*keys, "i", "j", (tile("i") + F.col("o.x")).alias("x"), (tile("j") + F.col("o.y")).alias("y"))
        d2 = ((F.col("i") - F.col("si")) * (F.col("i") - F.col("si")) + (F.col("j") - F.col("sj")) * (F.col("j") - F.col("sj"))).cast("long")
        met = asked.join(dealt.hint("merge"), [*keys, "x", "y"]).groupBy(*keys, "i", "j").agg(F.min(F.struct(d2.alias("d2"), F.col("sid").cast("int").alias("sid"), F.col("v").cast("double").alias("v"))).alias("s"))
        now = left.select(*keys, "i", "j", "s").unionByName(met).groupBy(*keys, "i", "j").agg(F.min("s").alias("s"))  # passes over nulls
        at = lambda c: F.least(F.col(c) % side, side - 1 - F.col(c) % side)
        edge = F.least(at("i"), at("j")) + (ring * side + 1)
        now = stored(now.withColumn("_done", F.coalesce(F.col("s.d2") < edge * edge, F.lit(False)) | F.lit(ring * side >= n)))
        over = now.where("_done").drop("_done")
        settled = over if settled is None else settled.unionByName(over)
        left = now.where("not _done").drop("_done")
        if ring * side >= n or left.isEmpty():
            return settled.select(*keys, "i", "j", "s.sid", "s.v")
        ring += 1


def disk(n: int, radius: float) -> np.ndarray:
    """1 within ``radius`` of cell (0, 0) on a periodic grid."""
    d = np.minimum(np.arange(n), n - np.arange(n))
    return (np.sqrt(d[:, None] ** 2 + d[None, :] ** 2) <= radius).astype(np.float64)


def local_sum(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Periodic sums of fields over a symmetric neighbourhood."""
    return np.fft.ifft2(np.fft.fft2(x) * np.fft.fft2(kernel)).real


def nonlinear(fields: DataFrame, column: str = "field", outer: float = 3.0, inner: float = 1.5, weight: float = 1.0) -> DataFrame:
    """Adds observed: half the sum of squares within ``outer`` plus ``weight`` times that within ``inner``, periodic."""

    def compute(n: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        return (local_sum(x * x, 0.5 * disk(n, outer) + weight * disk(n, inner)),)

    return map_fields(fields, [column], {"observed": "array"}, compute)


def nonlinear_cells(cells: DataFrame, n: int, outer: float = 3.0, inner: float = 1.5, weight: float = 1.0) -> DataFrame:
    """run, t, i, j, v: the same on cells, each sending its square to its neighbours; offsets are a broadcast table of the disk's size."""
    near = F.col("di") * F.col("di") + F.col("dj") * F.col("dj") <= inner * inner
    offsets = F.broadcast(grids.disk_offsets(cells.sparkSession, outer).withColumn("w", F.lit(0.5) + F.when(near, weight).otherwise(0.0)))
    sent = cells.crossJoin(offsets).select("run", "t", F.pmod(F.col("i") + F.col("di"), F.lit(n)).alias("i"), F.pmod(F.col("j") + F.col("dj"), F.lit(n)).alias("j"), (F.col("w") * F.col("v") * F.col("v")).alias("v"))
    return sent.groupBy("run", "t", "i", "j").agg(F.sum("v").alias("v"))
