"""What several operators need: cutting lineage, reading tables, exact distributed top-k."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import shared_folder

#: Words are runs of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and stored in the shared folder; recovers from there if executors are lost.

    Shuffle files, and stored tables that nothing refers to any more, are deleted when the driver's JVM collects what they belong
    to. A job of many steps would keep them all until it happens to, so it is asked for here.
    """
    spark = df.sparkSession
    shared_folder(spark)
    stored = df.checkpoint()
    spark._jvm.System.gc()
    return stored


def small(stored: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``stored``, a table of a few numbers a row, to be broadcast if it has at most ``most`` rows (some 50 MB); beyond that its joins shuffle."""
    return F.broadcast(stored) if stored.count() <= most else stored


def unit_hash(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone: 52 bits of their MD5, a half added.

    MD5 of text, so that other engines give the same number.
    """
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of ``key``; reruns agree."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(most)


def short_batches(texts: DataFrame) -> DataFrame:
    """``texts``; where the session leaves Spark's 10,000 rows a batch to Python, it is told 1,000, as a row holds a whole text."""
    conf, key = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, "1000")
    return texts


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, at whose end what it has freed goes back to the machine: a Python worker stays after its task, beside others."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
