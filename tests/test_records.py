"""Record files: round trips of odd values, ranges that are opened, and commits that are seen once or not at all."""

from __future__ import annotations

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

from fieldloom.sources import records

KIND = "s string, k long, v double, b boolean, x array<double>"
ODD = [("a", 1, 1.5, True, [1.0, 2.0]), (None, None, None, None, None), ("é\0", 3, math.inf, False, [3.0, 4.0]), ("", 2, -0.0, True, [0.0, 0.0]), ("", 2, -0.0, True, [0.0, 0.0])]


def shown(df) -> list[str]:
    return sorted(map(str, df.collect()))


def test_odd_rows_come_back(spark, tmp_path):
    odd, path = spark.createDataFrame(ODD, KIND), str(tmp_path / "r")
    records.write_records(odd, path, "k")
    assert shown(records.read_records(spark, path)) == shown(odd)
    assert shown(records.read_records(spark, path, 1).where("k >= 2")) == shown(odd.where("k >= 2"))
    assert shown(records.read_records(spark, path).where("k is null")) == shown(odd.where("k is null"))
    assert shown(records.read_records(spark, path).where("k = 1 or s = ''")) == shown(odd.where("k = 1 or s = ''"))
    records.write_records(odd.limit(1), path, "k")
    assert records.read_records(spark, path).count() == len(ODD) + 1
    records.write_records(odd.where("k = 3"), path, "k", "overwrite")
    assert shown(records.read_records(spark, path)) == shown(odd.where("k = 3"))
    records.write_records(odd.where("false"), path, "k", "overwrite")
    assert records.read_records(spark, path).count() == 0


def test_ranges_that_are_opened(spark, tmp_path):
    path = str(tmp_path / "r")
    for a in (0, 500):
        records.write_records(spark.range(a, a + 500).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("v")), path, "k")
    source = records.RecordSource({"path": path, "records_per_partition": "50"})
    reader = source.reader(source.schema())
    everything = reader.partitions()
    asked = [GreaterThanOrEqual(("k",), 10), LessThan(("k",), 20)]
    assert list(reader.pushFilters(asked)) == asked  # Spark applies them again
    some = reader.partitions()
    assert sum(p.last - p.first for p in everything) == 1000
    assert len({p.name for p in everything}) > 1 and len({p.name for p in some}) == 1 and len(some) < len(everything)
    got = sorted(k for p in some for b in reader.read(p) for k in b.column(0).to_pylist())
    assert got == list(range(10, 21))  # the bound of < is taken as <=, and Spark drops it
    assert records.read_records(spark, path).where("k >= 10 and k < 20").count() == 10
    where = str(next(p for p in (tmp_path / "r").glob("*.npy") if p.name == some[0].name))
    with open(where, "rb") as f:
        kind, _, begins = records.header(f)
        assert records.bounded(f, kind, begins, "k", records.Range("", 0, 500, 10, 20, True)) == (10, 21)
        assert records.bounded(f, kind, begins, "k", records.Range("", 50, 100, 10, 20, True)) == (50, 50)
        assert records.bounded(f, kind, begins, "k", records.Range("", 50, 100, 90, float("inf"), True)) == (90, 100)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    records.read_records(spark, path)
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == before


@pytest.mark.parametrize("version", [(1, 0), (2, 0)])
def test_headers_of_files(version):
    rows = np.zeros(7, dtype=[("k", "<i8"), ("x", "<f8", (3,))])
    data = io.BytesIO()
    np.lib.format.write_array(data, rows, version)
    size = data.tell()
    data.seek(0)
    kind, n, begins = records.header(data)
    assert (kind, n, begins) == (rows.dtype, 7, size - rows.nbytes)


def test_only_commits_are_seen(spark, tmp_path):
    path = str(tmp_path / "r")
    records.write_records(spark.range(5).withColumnRenamed("id", "k"), path, "k")
    schema = records.read_records(spark, path).schema
    batches = spark.range(3).withColumnRenamed("id", "k").toArrow().to_batches()
    source = records.RecordSource({"path": path, "key": "k", "stream": "s"})
    first, again, failed = (source.streamWriter(schema, False) for _ in range(3))
    lost = failed.write(iter(batches))
    assert records.read_records(spark, path).count() == 5  # written, not committed
    failed.abort([lost, None], 0)
    first.commit([first.write(iter(batches)), None], 0)
    assert records.read_records(spark, path).count() == 8
    again.commit([again.write(iter(batches))], 0)  # the same batch
    assert records.read_records(spark, path).count() == 8
    first.commit([first.write(iter(batches))], 1)
    assert records.read_records(spark, path).count() == 11
    named = {f for c in records.commits(path).values() for f, *_ in c["files"]}
    assert {p.name for p in (tmp_path / "r").glob("*.npy")} == named  # nothing is left of what wasn't committed


def test_what_is_refused(spark, tmp_path):
    path = str(tmp_path / "r")
    with pytest.raises(Exception, match="no integer"):
        records.write_records(spark.createDataFrame([(1.0,)], "k double"), path, "k")
    with pytest.raises(Exception, match="nothing is committed"):
        records.read_records(spark, path).count()
    with pytest.raises(Exception, match="differ in length"):
        records.write_records(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k long, x array<double>"), path, "k")
