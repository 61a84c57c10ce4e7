"""Stored stacks: partitioned Parquet, caches keyed by their parameters, raw binary records, run folders."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldloom.sources.records import opened


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_stack(fields: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A stack, partitioned by run, so that a run's scan reads its files only."""
    fields.write.mode(mode).partitionBy("run").parquet(path)


def read_stack(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def key_of(parameters: dict) -> str:
    """A name that full-precision parameters alone determine."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=repr).encode()).hexdigest()[:20]


def cached(spark: SparkSession, folder: str, name: str, parameters: dict, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What ``make`` gives, written once under its parameters' key and read from there; made anew if ``force``."""
    path = f"{folder}/{name}-{key_of(parameters)}"
    if force or not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_folder(n: int, tau0: float, forcing: str, parameters: dict) -> str:
    """A run's folder: its size, forcing and wind, and the key of all its parameters (short decimals alone would collide)."""
    return f"N{n}/baro_N{n}_forcing-{forcing}_tau0-{tau0:.2g}_{key_of(parameters)}"


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of files, from metadata alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, folder, file_name and length of the files whose name fits a glob pattern, at any depth; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    parts = F.split("path", "/")
    return found.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file_name"), "length")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The runs of an ensemble as lines of JSON, readable by other programs."""
    manifest.coalesce(1).write.mode("overwrite").json(path)  # a row for each run


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run int, tau0 double, split string, n int, snapshots long").json(path)


def write_diagnostics(records: DataFrame, path: str, mode: str = "append") -> None:
    """Diagnostics of runs as they come; a run's records lie in a folder of its own, and a later call adds to them."""
    records.write.mode(mode).partitionBy("run").parquet(path)


def read_diagnostics(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """All diagnostics, or the named columns alone."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def write_weights(spark: SparkSession, weights: np.ndarray, path: str) -> None:
    """A weight matrix, a row for each of its rows."""
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.atleast_2d(weights))]
    spark.createDataFrame(rows, "row int, values array<double>").write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> np.ndarray:
    """The matrix that ``write_weights`` wrote; it has the size of a grid, not of the data."""
    return np.array([r["values"] for r in spark.read.parquet(path).orderBy("row").collect()])


class _Records(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        super().__init__(None)
        self.path, self.first, self.last = path, first, last


class _RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.n, self.per = options["path"], int(options["n"]), int(options.get("records_per_partition", "256"))

    def partitions(self) -> list[InputPartition]:
        store, path = opened(self.path)
        records = (store.get_file_info(path).size or 0) // (16 * self.n**2)
        return [_Records(self.path, a, min(records, a + self.per)) for a in range(0, records, self.per)] or [_Records(self.path, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        size = self.n**2
        store, path = opened(partition.path)
        with store.open_input_file(path) as f:
            f.seek(partition.first * 16 * size)
            for t in range(partition.first, partition.last):
                x = np.frombuffer(f.read(16 * size), dtype=np.float64)
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([self.n], pa.int32()), pa.array([x[:size]], kind), pa.array([x[size:]], kind)], ["t", "n", "re", "im"])


class RawSpectralSource(DataSource):
    """``raw_spectral``: t, n, re, im of a file of records of n * n real, then n * n imaginary parts, doubles in the machine's order.

    Options: path (a URI of shared storage, or a path that all workers mount), n, records_per_partition. Trailing bytes short of a record are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_spectral"

    def schema(self) -> str:
        return "t int, n int, re array<double>, im array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _RawReader(self.options)


def raw_spectral(spark: SparkSession, path: str, n: int, records_per_partition: int = 256) -> DataFrame:
    spark.dataSource.register(RawSpectralSource)
    return spark.read.format("raw_spectral").option("path", path).option("n", n).option("records_per_partition", records_per_partition).load()


def write_records(analyses: DataFrame, path: str) -> None:
    """Experiment records, a row for each snapshot with its arrays."""
    analyses.write.mode("overwrite").parquet(path)


def cost_history(analyses: DataFrame, *methods: str) -> DataFrame:
    """run, t, method, eval, cost: a row for each evaluation (not each iteration)."""
    listed = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_cost").alias("cost")) for m in methods])
    flat = analyses.select("run", "t", F.explode(listed).alias("h")).select("run", "t", "h.method", F.posexplode("h.cost").alias("eval", "cost"))
    return flat
