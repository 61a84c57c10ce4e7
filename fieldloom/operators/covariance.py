"""Stationary and sample covariances, correlated noise, and the bases of a stack of fields.

What is gathered to the driver has the size of one grid (n * n) or of its square, never of the stack.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import grids, scalar
from fieldloom.operators.batch import map_fields


MOST_BLOCKS = 64  # pairs of blocks of cells whose sums a task of ``gram`` keeps


def correlation_spectrum(n: int, length: float, localize: bool = False) -> np.ndarray:
    """(n, n) spectrum of the periodic Matern correlation, negative rounding set to 0."""
    d = np.minimum(np.arange(n), n - np.arange(n))
    r = np.sqrt(d[:, None] ** 2 + d[None, :] ** 2)
    c = (1 + r / length) * np.exp(-r / length)
    return np.clip(np.fft.fft2(c * taper(r / length) if localize else c).real, 0, None)


def taper(rho: np.ndarray) -> np.ndarray:
    """The compactly supported taper on an array. The coefficients are fixed values of the published function."""
    rho = np.asarray(rho, dtype=np.float64)
    near = np.polyval([-1 / 4, 1 / 2, 5 / 8, -5 / 3, 0, 1], rho)
    safe = np.maximum(rho, 1)
    far = np.polyval([1 / 12, -1 / 2, 5 / 8, 5 / 3, -5, 4], safe) - 2 / 3 / safe
    return np.where(rho < 1, near, np.where(rho < 2, far, 0.0))


def filtered(fields: DataFrame, spectrum: np.ndarray, name: str, inverse: bool = False, eps: float = 1e-8, column: str = "field") -> DataFrame:
    """Adds a field times a stationary covariance, or divided by it (regularised by eps times its largest value)."""
    factor = 1 / (spectrum + eps * spectrum.max()) if inverse else spectrum
    return map_fields(fields, [column], {name: "array"}, lambda n, x: (np.fft.ifft2(np.fft.fft2(x) * factor).real,))


def with_background(fields: DataFrame, std: float, length: float, seed: int = 0, localize: bool = False, column: str = "field") -> DataFrame:
    """Adds noise, correlated and of unit deviation in each field, seeded by run and t, and x_b, the field plus ``std`` times it."""

    def compute(n: int, x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        amplitude = np.sqrt(correlation_spectrum(n, length, localize))
        white = np.stack([np.random.default_rng([seed, int(k) & (2**63 - 1)]).standard_normal((n, n)) for k in keys[:, 0, 0]])
        noise = np.fft.ifft2(np.fft.fft2(white) * amplitude).real
        noise /= noise.std((1, 2), keepdims=True)
        return noise, x + std * noise

    key = F.pmod(F.xxhash64("run", "t"), F.lit(1 << 50)).cast("double")
    keyed = fields.withColumn("_key", F.array_repeat(key, F.col("n") * F.col("n")))
    return map_fields(keyed, [column, "_key"], {"noise": "array", "x_b": "array"}, compute, fields.columns)


def localized_covariance(cells: DataFrame, length: float) -> DataFrame:
    """ai, aj, bi, bj, p: second moments (mean not removed) over n - 1 snapshots of pairs of cells closer than twice ``length``, tapered.

    Cells are bucketed by squares of that side, and a cell meets those of its own and the adjoining squares of
    its snapshot alone, so far pairs never arise.
    """
    side = int(np.ceil(2 * length))
    a = cells.select("run", "t", F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("v").alias("va"), F.floor(F.col("i") / side).alias("x"), F.floor(F.col("j") / side).alias("y"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = cells.select("run", "t", F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("v").alias("vb"), F.explode(F.transform(near, lambda d: F.floor(F.col("i") / side) + d)).alias("x"))
    b = b.select("run", "t", "bi", "bj", "vb", "x", F.explode(F.transform(near, lambda d: F.floor(F.col("bj") / side) + d)).alias("y"))
    distance = F.sqrt(((F.col("ai") - F.col("bi")) ** 2 + (F.col("aj") - F.col("bj")) ** 2).cast("double"))
    pairs = a.join(b, ["run", "t", "x", "y"]).withColumn("d", distance).where(F.col("d") < 2 * length)
    count = cells.select("run", "t").distinct().agg(F.count("*").alias("snapshots"))
    sums = pairs.groupBy("ai", "aj", "bi", "bj", "d").agg(F.sum(F.col("va") * F.col("vb")).alias("s")).crossJoin(F.broadcast(count))
    return sums.select("ai", "aj", "bi", "bj", (F.col("s") / (F.col("snapshots") - 1) * scalar.gaspari_cohn(F.col("d") / length)).alias("p"))


def localized_moments(fields: DataFrame, length: float, column: str = "field") -> DataFrame:
    """The same from packed fields: a task adds the products of its own fields up, offset by offset, so that what is shuffled is a row for each pair of near cells and task."""
    from collections.abc import Iterator

    import pyarrow as pa

    from fieldloom.operators.batch import stacked

    reach = int(2 * length)
    offsets = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b < 4 * length**2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for b in batches:
            sizes = b.column(0).to_numpy()
            for n in map(int, np.unique(sizes)):
                x = stacked(b.filter(pa.array(sizes == n)).column(1), (n, n))
                total = sums.setdefault(n, np.zeros((len(offsets), n, n)))
                rows[n] = rows.get(n, 0) + len(x)
                for k, (di, dj) in enumerate(offsets):
                    i, j = slice(max(0, -di), min(n, n - di)), slice(max(0, -dj), min(n, n - dj))
                    if i.start < i.stop and j.start < j.stop:
                        total[k, i, j] += np.einsum("tij,tij->ij", x[:, i, j], x[:, i.start + di : i.stop + di, j.start + dj : j.stop + dj])
        for n, total in sums.items():
            i, j = np.divmod(np.arange(n * n), n)
            for (di, dj), s in zip(offsets, total, strict=True):
                there = (i + di >= 0) & (i + di < n) & (j + dj >= 0) & (j + dj < n)
                ints = [pa.array(v[there].astype(np.int32)) for v in (i, j, i + di, j + dj)]
                yield pa.RecordBatch.from_arrays([*ints, pa.array(s.ravel()[there]), pa.array(np.full(int(there.sum()), rows[n]))], ["ai", "aj", "bi", "bj", "s", "rows"])

    parts = fields.select("n", F.col(column)).mapInArrow(run, "ai int, aj int, bi int, bj int, s double, rows long")
    sums = parts.groupBy("ai", "aj", "bi", "bj").agg(F.sum("s").alias("s"), F.sum("rows").alias("snapshots"))
    distance = F.sqrt(((F.col("ai") - F.col("bi")) ** 2 + (F.col("aj") - F.col("bj")) ** 2).cast("double"))
    return sums.select("ai", "aj", "bi", "bj", (F.col("s") / (F.col("snapshots") - 1) * scalar.gaspari_cohn(distance / length)).alias("p"))


def kernel_table(spark, n: int, length: float) -> DataFrame:
    """r, matern and taper at the distances 0 .. n - 1."""
    r = F.col("id").cast("double")
    return spark.range(n).select(F.col("id").cast("int").alias("r"), scalar.matern32(r, length).alias("matern"), scalar.gaspari_cohn(r / length).alias("taper"))


def spectrum_cells(spark, n: int, length: float, localize: bool = False) -> DataFrame:
    """ki, kj, sk by joins alone."""
    from fieldloom.operators.spectral import dft2_cells

    kernel = grids.radial_kernel(spark, n, length, localize).withColumns({"run": F.lit(0), "t": F.lit(0)})
    return dft2_cells(kernel, n).select("ki", "kj", F.greatest(F.col("re"), F.lit(0.0)).alias("sk"))


def gram(fields: DataFrame, column: str = "field", block: int = 512) -> DataFrame:
    """a, b, g for a <= b: sums over all snapshots of products of cells a and b; (n * n)^2 / 2 rows out.

    Cells are cut into blocks; a task adds products up by pair of blocks over its snapshots, at most ``MOST_BLOCKS`` pairs (128 MB) beyond
    a batch, so that what is shuffled is a row for each pair of cells and task, not one for each snapshot. Null fields take no part.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    from fieldloom.operators.batch import stacked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for size in map(int, np.unique(b.column(0).to_numpy())):
                x = stacked(b.filter(pa.array(b.column(0).to_numpy() == size)).column(1), (size,))
                cuts = range(0, size, block)
                for p in cuts:
                    for q in cuts[p // block :]:
                        part = x[:, p : p + block].T @ x[:, q : q + block]
                        key = (p, q)
                        old = sums.get(key)
                        if old is None or old.shape == part.shape:
                            sums[key] = part if old is None else old + part
                        else:  # grids of another size
                            yield rows_of(key, part)
            while len(sums) > MOST_BLOCKS:
                key = next(iter(sums))
                yield rows_of(key, sums.pop(key))
        for key, total in sums.items():
            yield rows_of(key, total)

    def rows_of(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        a, b = (np.repeat(np.arange(total.shape[0]), total.shape[1]) + key[0], np.tile(np.arange(total.shape[1]), total.shape[0]) + key[1])
        keep = a <= b
        return pa.RecordBatch.from_arrays([pa.array(a[keep].astype(np.int32)), pa.array(b[keep].astype(np.int32)), pa.array(total.ravel()[keep])], ["a", "b", "g"])

    parts = fields.where(F.col(column).isNotNull()).select(F.size(column).alias("size"), column).mapInArrow(run, "a int, b int, g double")
    return parts.groupBy("a", "b").agg(F.sum("g").alias("g"))


def moments(fields: DataFrame, columns: tuple[str, str]) -> np.ndarray:
    """Sum over all rows of the outer product of two packed fields; matrices add up in the tasks, one for each task comes back."""
    from collections.abc import Iterator

    import pyarrow as pa

    from fieldloom.operators.batch import stacked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for b in batches:
            if b.num_rows:
                m = len(b.column(0)[0])
                part = stacked(b.column(0), (m,)).T @ stacked(b.column(1), (len(b.column(1)[0]),))
                acc = part if acc is None else acc + part
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc), dtype=np.int32)), pa.array(list(acc))], ["row", "values"])

    parts = fields.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(run, "row int, values array<double>")
    summed = parts.select("row", F.posexplode("values").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("c"))
    rows = summed.select("row", F.transform("c", lambda x: x["v"]).alias("v")).orderBy("row").collect()  # a row for each cell
    return np.array([r.v for r in rows])


def pod(fields: DataFrame, q: int, column: str = "field") -> tuple[np.ndarray, np.ndarray]:
    """(cells, q) leading left vectors of the stack, not centred, and all its singular values. The largest entry of a vector is positive."""
    values, vectors = np.linalg.eigh(moments(fields, (column, column)))
    order = np.argsort(values)[::-1]
    basis = vectors[:, order[:q]]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    return basis, np.sqrt(np.clip(values[order], 0, None))


def captured(singular: DataFrame) -> DataFrame:
    """``singular`` (mode, s) with energy, the share of all squares up to each mode."""
    square = F.col("s") * F.col("s")
    return singular.withColumn("energy", F.sum(square).over(Window.orderBy("mode")) / F.sum(square).over(Window.partitionBy()))


def projected(fields: DataFrame, basis: np.ndarray, column: str = "field") -> DataFrame:
    """Adds reduced, the coefficients in a basis, and restored, the field they stand for."""

    def compute(n: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        c = x.reshape(len(x), -1) @ basis
        return c, c @ basis.T

    return map_fields(fields, [column], {"reduced": "array", "restored": "array"}, compute)


def pseudo_inverse(p: np.ndarray, cutoff: float = 1e-2) -> np.ndarray:
    """Inverse over singular values above ``cutoff`` times the largest."""
    return np.linalg.pinv(p, rcond=cutoff)


def dense_localized(residuals: DataFrame, n: int, length: float, column: str = "residual") -> np.ndarray:
    """(n^2, n^2) tapered second moments of residual fields over their number less one."""
    i, j = np.divmod(np.arange(n * n), n)
    d = np.sqrt((i[:, None] - i) ** 2 + (j[:, None] - j) ** 2)
    return moments(residuals, (column, column)) / (residuals.count() - 1) * taper(d / length)
