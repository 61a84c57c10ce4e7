"""``npy_records``: rows as fixed-length records of .npy files, with reads by range and writes that commit.

A folder holds .npy files of one structured array each, and ``_commits``, where one small JSON file for each finished write
names its files with their records and the bounds of the key column. A write's first phase leaves files that nothing
names; its second puts the commit file in place by a rename. Readers look at commits alone, so rows of failed, doubled or
unfinished tasks are never seen, and a stream's batch that is given again finds its commit there and changes nothing.

Options: path (a URI or path that driver and workers see alike, opened by pyarrow's file systems), key (an integer column that filters
skip files and ranges by), records_per_partition, and for streams ``stream``, the name that its batches are numbered under.
Columns: integers, doubles, booleans, strings (as wide as a file's longest) and arrays of double (of one length in a file);
any may be null. Records keep the order in which a task got them: sort within partitions by the key, so that ranges can be skipped.
"""

from __future__ import annotations

import io
import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FILE_BYTES = 1 << 26  # a task's records are cut into files of about this size
VALID = "_valid"  # a bit for each column: whether it is there


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; a plain path is one that all machines mount."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _text(store: fs.FileSystem, path: str) -> str:
    with store.open_input_stream(path) as f:
        return f.read().decode()


def header(f) -> tuple[np.dtype, int, int]:
    """Type of a record, number of records and where they begin, of an open .npy file of one dimension; no record is read."""
    start = io.BytesIO(f.read(12))
    version = np.lib.format.read_magic(start)
    length = int.from_bytes(start.read(2 if version == (1, 0) else 4), "little")
    begins = start.tell() + length
    f.seek(0)
    whole = io.BytesIO(f.read(begins))
    np.lib.format.read_magic(whole)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, _, kind = read(whole)
    if len(shape) != 1:
        raise ValueError(f"records of one dimension, not of shape {shape}")
    return kind, shape[0], begins


def packed(table: pa.Table) -> np.ndarray:
    """A structured array of the rows of ``table``, with the bits of what is not null."""
    if table.num_columns > 64:
        raise ValueError("at most 64 columns")
    kinds, columns, valid = [], [], np.zeros(len(table), np.uint64)
    for i, name in enumerate(table.column_names):
        c = table.column(name).combine_chunks()
        there = c.is_valid().to_numpy(zero_copy_only=False)
        valid |= there.astype(np.uint64) << np.uint64(i)
        if pa.types.is_list(c.type):
            sizes = set(c.value_lengths().drop_null().to_pylist())
            if len(sizes) > 1 or c.flatten().null_count:
                raise ValueError(f"arrays of {name} differ in length within a file, or hold nulls")
            n = sizes.pop() if sizes else 0
            x = np.zeros((len(c), n))
            x[there] = c.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            kinds.append((name, "<f8", (n,)))
        elif pa.types.is_string(c.type):
            coded = [b"" if v is None else v.encode() for v in c.to_pylist()]
            # A mark at the end keeps NULs there, which fixed widths would lose.
            x = np.array([v + b"\x01" for v in coded], dtype=f"S{max(map(len, coded), default=0) + 1}")
            kinds.append((name, x.dtype.str))
        else:
            x = c.fill_null(pa.scalar(0, pa.int8()).cast(c.type)).to_numpy(zero_copy_only=False)
            kinds.append((name, x.dtype.newbyteorder("<").str))
        columns.append(x)
    out = np.zeros(len(table), dtype=[*kinds, (VALID, "<u8")])
    for name, x in zip(table.column_names, columns, strict=True):
        out[name] = x
    out[VALID] = valid
    return out


def unpacked(rows: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """The rows that ``packed`` put together."""
    columns = []
    for i, field in enumerate(schema):
        x, gone = rows[field.name], (rows[VALID] >> np.uint64(i)) & np.uint64(1) == 0
        if pa.types.is_list(field.type):
            columns.append(pa.array([None if g else v for v, g in zip(x, gone, strict=True)], field.type))
        elif pa.types.is_string(field.type):
            columns.append(pa.array([None if g else v[:-1].decode() for v, g in zip(x.tolist(), gone, strict=True)], field.type))
        else:
            columns.append(pa.array(np.ascontiguousarray(x), field.type, mask=gone))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


# --- Writing --------------------------------------------------------------------------


@dataclass
class Files(WriterCommitMessage):
    """What a task wrote: name, number of records, least and greatest key of each file, and whether its records are in their order."""

    files: list[tuple[str, int, int | None, int | None, bool]]


class _Writing:
    """Both phases, shared by writes of tables and of streams."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.key, self.schema = options["path"], options.get("key"), schema.json()
        if self.key and schema[self.key].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise ValueError(f"the key {self.key} is no integer")
        self.stream, self.name = options.get("stream", "stream"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        store, path = opened(self.path)
        store.create_dir(path, recursive=True)
        found, waiting, held = [], [], 0

        def put() -> None:
            rows = pa.Table.from_batches(waiting)
            name = f"{uuid.uuid4().hex}.npy"
            data = io.BytesIO()
            np.save(data, packed(rows), allow_pickle=False)
            with store.open_output_stream(f"{path}/{name}") as f:
                f.write(data.getbuffer())
            keys = rows.column(self.key).drop_null().to_numpy() if self.key else np.empty(0)
            ordered = len(keys) == len(rows) and bool((keys[1:] >= keys[:-1]).all())
            found.append((name, len(rows), *((keys.min().item(), keys.max().item()) if len(keys) else (None, None)), ordered))

        for batch in iterator:
            if batch.num_rows:
                waiting.append(batch)
                held += batch.nbytes
            if held >= FILE_BYTES:
                put()
                waiting, held = [], 0
        if waiting:
            put()
        return Files(found)

    def finish(self, messages: list[Files | None], name: str, replaces: list[str]) -> None:
        """The second phase; if a commit of that name is there already, this write's files go and nothing else happens."""
        store, path = opened(self.path)
        store.create_dir(f"{path}/_commits", recursive=True)
        if store.get_file_info(f"{path}/_commits/{name}.json").type != fs.FileType.NotFound:
            return self.abort(messages)
        files = [f for m in messages if m for f in m.files]
        body = json.dumps({"schema": json.loads(self.schema), "key": self.key, "files": files, "replaces": replaces})
        with store.open_output_stream(f"{path}/_commits/{name}.{self.name}.part") as f:
            f.write(body.encode())
        store.move(f"{path}/_commits/{name}.{self.name}.part", f"{path}/_commits/{name}.json")

    def abort(self, messages: list[Files | None], *_: int) -> None:
        store, path = opened(self.path)
        for m in messages:
            for name, *_ in m.files if m else []:
                store.delete_file(f"{path}/{name}")


class _TableWriter(_Writing, DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        super().__init__(options, schema)
        self.overwrite = overwrite

    def commit(self, messages: list[Files | None]) -> None:
        self.finish(messages, f"table-{self.name}", sorted(commits(self.path)) if self.overwrite else [])


class _StreamWriter(_Writing, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Files | None], batchId: int) -> None:
        self.finish(messages, f"{self.stream}-{batchId:012d}", [])


# --- Reading --------------------------------------------------------------------------


def commits(path: str) -> dict[str, dict]:
    """The commits of a folder that no later one replaces, by name. A commit lists some hundred bytes for each 64 MB of records."""
    store, folder = opened(path)
    listed = store.get_file_info(fs.FileSelector(f"{folder}/_commits", allow_not_found=True))
    found = {f.base_name.removesuffix(".json"): json.loads(_text(store, f.path)) for f in listed if f.extension == "json"}
    gone = {name for c in found.values() for name in c["replaces"]}
    return {name: c for name, c in found.items() if name not in gone}


@dataclass
class Range(InputPartition):
    """Records ``first`` to ``last`` (exclusive) of a file, of which keys from ``low`` to ``high`` are asked for."""

    name: str
    first: int
    last: int
    low: float  # an integer, or an infinity
    high: float
    ordered: bool


def bounded(f, kind: np.dtype, begins: int, key: str, part: Range) -> tuple[int, int]:
    """First and last (exclusive) record of a range, ordered by the key, whose key is within the bounds: by halving, a key read at each step."""

    def key_of(record: int) -> int:
        f.seek(begins + record * kind.itemsize)
        return np.frombuffer(f.read(kind.itemsize), kind)[key][0].item()

    records = range(part.first, part.last)
    first = part.first + bisect_left(records, part.low, key=key_of)
    return first, part.first + bisect_right(records, part.high, lo=first - part.first, key=key_of)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.per, self.wanted = options["path"], int(options.get("records_per_partition", "65536")), to_arrow_schema(schema)
        self.found = commits(self.path)
        self.keys = {c["key"] for c in self.found.values()}
        self.low, self.high = float("-inf"), float("inf")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes bounds of the key for skipping; Spark applies all filters again to what is read."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and self.keys == {".".join(f.attribute)} and isinstance(f.value, int):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[Range]:
        free = self.low == float("-inf") and self.high == float("inf")
        out = []
        for c in self.found.values():
            for name, records, low, high, ordered in c["files"]:
                # Null keys are in no bounds, and no bound on the key keeps them.
                if free or (low is not None and low <= self.high and high >= self.low):
                    out += [Range(name, a, min(records, a + self.per), self.low, self.high, ordered) for a in range(0, records, self.per)]
        return out or [Range("", 0, 0, self.low, self.high, False)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        store, path = opened(self.path)
        with store.open_input_file(f"{path}/{part.name}") as f:
            kind, _, begins = header(f)
            step = max(1, (1 << 22) // kind.itemsize)
            key = next(iter(self.keys)) if part.low > float("-inf") or part.high < float("inf") else None
            first, last = bounded(f, kind, begins, key, part) if key and part.ordered else (part.first, part.last)
            for a in range(first, last, step):
                f.seek(begins + a * kind.itemsize)
                rows = np.frombuffer(f.read((min(last, a + step) - a) * kind.itemsize), kind)
                if key and not part.ordered:
                    rows = rows[(rows[key] >= part.low) & (rows[key] <= part.high)]
                if len(rows):
                    yield unpacked(rows, self.wanted)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_records"

    def schema(self) -> StructType:
        found = commits(self.options["path"])
        if not found:
            raise FileNotFoundError(f"nothing is committed in {self.options['path']}")
        return StructType.fromJson(found[min(found)]["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _TableWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options, schema)


class SkippingSource(RecordSource):
    """The same under a name of its own, as Spark refuses a name that the active session has."""

    @classmethod
    def name(cls) -> str:
        return "npy_records_skipping"


def write_records(rows: DataFrame, path: str, key: str, mode: str = "append") -> None:
    """``rows`` as records in ranges of ``key``, so that each file has its own bounds; ``mode`` is append or overwrite."""
    rows.sparkSession.dataSource.register(RecordSource)
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key)
    ranged.write.format("npy_records").option("path", path).option("key", key).mode(mode).save()


def read_records(spark: SparkSession, path: str, records_per_partition: int = 65536) -> DataFrame:
    """All committed rows. Filters on the key skip files and records; the frame's session has them pushed down, the caller's is left as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own.dataSource.register(SkippingSource)
    return own.read.format("npy_records_skipping").option("path", path).option("records_per_partition", records_per_partition).load()
