"""numpy over Arrow batches of packed fields: the one place where rows meet Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def stacked(column: pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    """An array column whose rows all have prod(shape) numbers, as (rows, *shape)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), *shape)


def listed(x: np.ndarray) -> pa.Array:
    """(rows, ...) as an array column of double; (rows,) as a double column."""
    if x.ndim == 1:
        return pa.array(x)
    flat = np.ascontiguousarray(x.reshape(len(x), -1))
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))


def map_fields(df: DataFrame, inputs: list[str], outputs: dict[str, str], compute: Callable[..., tuple[np.ndarray, ...]], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``outputs`` (name: 'array' or 'double') computed from fields.

    ``compute(n, *stacks)`` gets the columns ``inputs`` of rows of one grid size as (rows, n, n), and
    returns an array for each output with the rows first. Rows stay where they are: no shuffle.
    """
    keep = keep or df.columns
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, T.ArrayType(T.DoubleType()) if kind == "array" else T.DoubleType()) for c, kind in outputs.items()]])
    columns = [*keep, *[c for c in inputs if c not in keep], *(["n"] if "n" not in [*keep, *inputs] else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(columns.index("n")).to_numpy()
            for n in np.unique(sizes):
                part = b.filter(pa.array(sizes == n)) if (sizes != n).any() else b
                found = compute(int(n), *[stacked(part.column(columns.index(c)), (int(n), int(n))) for c in inputs])
                yield pa.RecordBatch.from_arrays([*[part.column(columns.index(c)) for c in keep], *map(listed, found)], [*keep, *outputs])

    return df.select(*columns).mapInArrow(run, schema)
