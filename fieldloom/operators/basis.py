"""Leading modes of a stack of fields as a table, whatever the size of a field or of the stack.

The modes are the eigenvectors of G = A'A, where a row of A is a field. G is never formed: a block Krylov iteration from random columns multiplies by
it in one pass over the stack a step, products added up in the tasks. Columns are a table with a row for each block of cells, all columns of
the block in one array; they are made orthonormal by a tall-skinny QR, whose small factors tasks make and a tree of shuffles merges. Only matrices
of columns by columns come to the driver, where the projected problem is solved; its residuals say when to stop.

A field of at most ``BLOCK`` cells is one block, whose columns go through the driver to all tasks, and then nothing of the stack is shuffled. Of larger ones, the blocks meet by run and t in each
step. Fields of a stack must have the same number of cells. Keys (run, t) must not repeat where a field has several blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.batch import listed, stacked
from fieldloom.session import stored

BLOCK = 4096
SCHEMA = "block int, v array<double>"


def _batches(rows: DataFrame, schema: str, step: Callable[[pa.RecordBatch], Iterator[list]], names: list[str], end: Callable[[], Iterator[list]] | None = None) -> DataFrame:
    """``rows`` through ``step``, batch by batch, and what ``end`` gives after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for out in step(b):
                    yield pa.RecordBatch.from_arrays(out, names)
        for out in end() if end else ():
            yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, schema)


def _added(parts: DataFrame, tasks: int) -> DataFrame:
    """(block, v) with the arrays of a block added up as they stream in."""
    total: dict[int, np.ndarray] = {}

    def step(b: pa.RecordBatch) -> Iterator[list]:
        for block, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = v.values.to_numpy()
            total[block] = total[block] + x if block in total else x.copy()
        return iter(())

    def end() -> Iterator[list]:
        for block, x in total.items():
            yield [pa.array([block], pa.int32()), listed(x[None])]

    return _batches(parts.repartition(tasks, "block"), SCHEMA, step, ["block", "v"], end)


def summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the arrays ``v``, each of ``shape``, as they stream into one task."""
    rows = _added(parts.select(F.lit(0).alias("block"), "v"), 1).collect()
    return np.array(rows[0].v).reshape(shape) if rows else np.zeros(shape)


@dataclass
class Columns:
    """``count`` columns over the cells: a row for each block, its columns one after the other in ``v``."""

    table: DataFrame
    count: int

    def times(self, matrix: np.ndarray) -> Columns:
        """The columns times a small matrix."""
        count = self.count

        def step(b: pa.RecordBatch) -> Iterator[list]:
            for block, v in zip(b.column(0), b.column(1), strict=True):
                yield [pa.array([block.as_py()], pa.int32()), listed((matrix.T @ v.values.to_numpy().reshape(count, -1))[None])]

        return Columns(_batches(self.table, SCHEMA, step, ["block", "v"]), matrix.shape[1])

    def inner(self, other: Columns) -> np.ndarray:
        """Products of every column with every one of the other's."""
        one, two = self.count, other.count

        def step(b: pa.RecordBatch) -> Iterator[list]:
            for v, w in zip(b.column(0), b.column(1), strict=True):
                yield [listed((v.values.to_numpy().reshape(one, -1) @ w.values.to_numpy().reshape(two, -1).T).reshape(1, -1))]

        met = self.table.join(other.table.withColumnRenamed("v", "w"), "block").select("v", "w")
        return summed(_batches(met, "v array<double>", step, ["v"]), (one, two))

    def less(self, other: Columns, matrix: np.ndarray) -> Columns:
        """The columns less the other's times a small matrix."""
        one, two = self.count, other.count

        def step(b: pa.RecordBatch) -> Iterator[list]:
            for block, v, w in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                yield [pa.array([block], pa.int32()), listed((v.values.to_numpy().reshape(one, -1) - matrix.T @ w.values.to_numpy().reshape(two, -1)).reshape(1, -1))]

        met = self.table.join(other.table.withColumnRenamed("v", "w"), "block").select("block", "v", "w")
        return Columns(stored(_batches(met, SCHEMA, step, ["block", "v"])), one)

    def beside(self, other: Columns) -> Columns:
        met = self.table.join(other.table.withColumnRenamed("v", "w"), "block").select("block", F.concat("v", "w").alias("v"))
        return Columns(stored(met), self.count + other.count)

    def triangle(self) -> np.ndarray:
        """R of the columns' QR. A task stacks its blocks under the factor so far; factors are merged eight by eight."""
        count = self.count

        def merged(rows: DataFrame) -> DataFrame:
            held = [np.zeros((0, count))]

            def step(b: pa.RecordBatch) -> Iterator[list]:
                for v in b.column(0):
                    held[0] = np.linalg.qr(np.vstack([held[0], v.values.to_numpy().reshape(count, -1).T]), mode="r")
                return iter(())

            def end() -> Iterator[list]:
                if len(held[0]):
                    yield [listed(held[0].T.reshape(1, -1))]

            return _batches(rows, "v array<double>", step, ["v"], end)

        rows, tasks = merged(self.table.select("v")), self.table.rdd.getNumPartitions()
        while tasks > 1:
            tasks = -(-tasks // 8)
            rows = merged(rows.repartition(tasks))
        return np.array(rows.first().v).reshape(count, -1).T

    def orthonormal(self, least: float = 1e-10) -> tuple[Columns, np.ndarray]:
        """Orthonormal columns of the same span and the matrix that gives these columns back; directions below ``least`` of the largest are left out."""
        now, back = self, np.eye(self.count)
        for _ in range(2):  # the second time removes what rounding leaves
            _, s, w = np.linalg.svd(now.triangle(), full_matrices=False)
            keep = s > least * max(s[0], 1e-300)
            now, back = now.times(w[keep].T / s[keep]), (s[keep, None] * w[keep]) @ back
        return Columns(stored(now.table), now.count), back


@dataclass
class Basis:
    columns: Columns
    singular: np.ndarray
    cells: int

    def rows(self) -> DataFrame:
        """(mode, cell, value), modes from 1."""
        width = (F.size("v") / max(1, self.columns.count)).cast("int")
        flat = self.columns.table.select("block", width.alias("w"), F.posexplode("v").alias("p", "value"))
        return flat.select((F.floor(F.col("p") / F.col("w")) + 1).cast("int").alias("mode"), (F.col("block") * BLOCK + F.col("p") % F.col("w")).alias("cell"), "value")

    def turned(self) -> Basis:
        """The same with each mode's largest value, the first of equals, positive."""
        peak = F.max(F.struct(F.abs("value").alias("size"), (-F.col("cell")).alias("first"), "value"))
        peaks = self.rows().groupBy("mode").agg(peak.alias("p")).select("mode", "p.value").orderBy("mode").collect()  # a row for each mode
        signs = np.diag([-1.0 if r.value < 0 else 1.0 for r in peaks])
        return Basis(Columns(stored(self.columns.times(signs).table), self.columns.count), self.singular, self.cells)

    def energy(self, fields: DataFrame, column: str = "field") -> DataFrame:
        """(mode, s, energy): singular values and the share of all squares up to each."""
        spark = fields.sparkSession
        whole = fields.agg(F.sum(F.aggregate(column, F.lit(0.0), lambda a, x: a + x * x)).alias("whole"))  # one row
        modes = [(k + 1, float(s), float(x)) for k, (s, x) in enumerate(zip(self.singular, np.cumsum(self.singular**2), strict=True))]
        return spark.createDataFrame(modes, "mode int, s double, some double").crossJoin(whole).select("mode", "s", (F.col("some") / F.col("whole")).alias("energy"))


def _blocks(fields: DataFrame, column: str, cells: int) -> DataFrame:
    if cells <= BLOCK:
        return fields.select("run", "t", F.lit(0).alias("block"), F.col(column).alias("x"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit((cells - 1) // BLOCK))).alias("block")
    return fields.select("run", "t", column, numbers).select("run", "t", "block", F.slice(column, F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias("x"))


def _sent(columns: Columns):
    """The columns of one block, at most ``BLOCK`` numbers each, on all executors: a row of the stack that had them beside it would be their size."""
    return columns.table.sparkSession.sparkContext.broadcast(np.array(columns.table.first().v).reshape(columns.count, -1))


def _with_products(fields: DataFrame, columns: Columns, column: str, cells: int) -> DataFrame:
    """run, t, block, x, v and y, the products of the whole field with the columns; without v if a field is one block, whose columns are sent to all tasks."""
    count = columns.count
    if cells <= BLOCK and count:
        sent = _sent(columns)

        def alone(b: pa.RecordBatch) -> Iterator[list]:
            yield [*b.columns, listed(stacked(b.column(3), (cells,)) @ sent.value.T)]

        met = _blocks(fields, column, cells)
        return _batches(met, f"{', '.join(f'{c} {kind}' for c, kind in met.dtypes)}, y array<double>", alone, [*met.columns, "y"])

    def step(b: pa.RecordBatch) -> Iterator[list]:
        y = np.stack([v.values.to_numpy().reshape(count, -1) @ x.values.to_numpy() for x, v in zip(b.column(3), b.column(4), strict=True)])
        yield [*b.columns, listed(y)]

    names = ["run", "t", "block", "x", "v", "y"]
    met = _blocks(fields, column, cells).join(columns.table, "block").select(names[:5])
    kinds = ", ".join(f"{c} {kind}" for c, kind in met.dtypes)
    met = _batches(met, f"{kinds}, y array<double>", step, names)
    if cells > BLOCK:
        whole = Window.partitionBy("run", "t")
        met = met.withColumn("y", F.array(*[F.sum(F.get("y", F.lit(k))).over(whole) for k in range(count)]))
    return met


def _gram_times(fields: DataFrame, columns: Columns, column: str, cells: int) -> Columns:
    """A'A times the columns, in one pass over the stack."""
    count = columns.count
    total: dict[int, np.ndarray] = {}

    def step(b: pa.RecordBatch) -> Iterator[list]:
        blocks = b.column(0).to_numpy()
        for block in np.unique(blocks).tolist():
            some = b.filter(pa.array(blocks == block))
            x, y = stacked(some.column(1), (len(some.column(1)[0]),)), stacked(some.column(2), (count,))
            total[block] = total.get(block, 0) + y.T @ x
        return iter(())

    def end() -> Iterator[list]:
        for block, x in total.items():
            yield [pa.array([block], pa.int32()), listed(x.reshape(1, -1))]

    parts = _batches(_with_products(fields, columns, column, cells).select("block", "x", "y"), SCHEMA, step, ["block", "v"], end)
    return Columns(stored(_added(parts, -(-cells // BLOCK))), count)


def leading(fields: DataFrame, modes: int, column: str = "field", more: int = 8, tolerance: float = 1e-9, steps: int = 50, seed: int = 0) -> Basis:
    """The ``modes`` leading left vectors of the stack, not centred, or as many as it has; the largest value of each is positive.

    ``more`` columns than modes are iterated until the residuals of all modes are below ``tolerance`` of the largest eigenvalue.
    """
    spark = fields.sparkSession
    sizes = fields.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if sizes[0] is None:
        return Basis(Columns(spark.createDataFrame([], SCHEMA), 0), np.empty(0), 0)
    if sizes[0] != sizes[1]:
        raise ValueError("fields of a stack must have the same number of cells")
    cells = sizes[0]
    width = min(cells, modes + more)

    def start(b: pa.RecordBatch) -> Iterator[list]:
        for block in b.column(0).to_pylist():
            x = np.random.default_rng([seed, block]).standard_normal((width, min(BLOCK, cells - block * BLOCK)))
            yield [pa.array([block], pa.int32()), listed(x.reshape(1, -1))]

    blocks = -(-cells // BLOCK)
    first = spark.range(0, blocks, 1, min(blocks, 64)).select(F.col("id").cast("int").alias("block"))
    last, _ = Columns(_batches(first, SCHEMA, start, ["block", "v"]), width).orthonormal()
    every, projected = last, np.zeros((0, 0))
    for step in range(steps):
        product = _gram_times(fields, last, column, cells)
        along = every.inner(product)
        grown = np.zeros((every.count, every.count))
        grown[: len(projected), : len(projected)] = projected
        grown[:, every.count - last.count :], grown[every.count - last.count :, :] = along, along.T
        projected = (grown + grown.T) / 2
        values, vectors = np.linalg.eigh(projected)
        order = np.argsort(values)[::-1][:modes]
        rest = product.less(every, along)
        rest = rest.less(every, every.inner(rest))
        gap = rest.triangle()
        off = np.linalg.norm(gap @ vectors[every.count - last.count :, order], axis=0)
        if every.count >= cells or off.max(initial=0) <= tolerance * max(values.max(), 1e-300) or step == steps - 1:
            break
        last, _ = rest.orthonormal(1e-8)
        every = every.beside(last)
    order = order[values[order] > 1e-14 * max(values.max(), 1e-300)]
    return Basis(Columns(stored(every.times(vectors[:, order]).table), len(order)), np.sqrt(values[order]), cells).turned()


def reduced(fields: DataFrame, basis: Basis, column: str = "field") -> DataFrame:
    """run, t and reduced, the coefficients of each field."""
    return _with_products(fields, basis.columns, column, basis.cells).where("block = 0").select("run", "t", F.col("y").alias("reduced"))


def restored(fields: DataFrame, basis: Basis, column: str = "field") -> DataFrame:
    """run, t, cell and v of what the coefficients of each field stand for."""
    count = basis.columns.count

    def step(b: pa.RecordBatch) -> Iterator[list]:
        for k in range(b.num_rows):
            x = np.asarray(b.column(4)[k].values.to_numpy()) @ b.column(3)[k].values.to_numpy().reshape(count, -1)
            yield [*[c.slice(k, 1) for c in b.columns[:3]], listed(x[None])]

    names = ["run", "t", "block", "x"]
    met = _with_products(fields, basis.columns, column, basis.cells)
    if basis.cells <= BLOCK and count:
        sent = _sent(basis.columns)

        def step(b: pa.RecordBatch) -> Iterator[list]:  # noqa: F811
            yield [*b.columns[:3], listed(stacked(b.column(3), (count,)) @ sent.value)]

    met = met.select("run", "t", "block", *(c for c in ("v", "y") if c in met.columns))
    kinds = ", ".join(f"{c} {kind}" for c, kind in met.dtypes[:3])
    rows = _batches(met, f"{kinds}, x array<double>", step, names)
    return rows.select("run", "t", "block", F.posexplode("x").alias("p", "v")).select("run", "t", (F.col("block") * BLOCK + F.col("p")).alias("cell"), "v")
