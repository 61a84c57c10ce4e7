"""The test tables read as fields, series and manifests; and readers of listed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators.series import BUCKET, numbered, preceded

SIDE = 8  # an embedding of 64 numbers is a field of 8 by 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of ``paths`` that Spark's file systems hold; FileNotFoundError if none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def by_suffix(files: DataFrame, name: str = "file_name", width: float = BUCKET) -> DataFrame:
    """``files`` with ``position`` (from 0), in order of the integer that ends the name before its extension; names without one come first.

    Suffixes are cut into buckets of ``width``, so names are ordered within a bucket; those without a suffix are one bucket.
    """
    number = F.regexp_extract(F.col(name), r"_(\d+)(?:\.[^.]*)?$", 1)
    return numbered(files.withColumn("suffix", F.when(number != "", number.cast("int"))), [], ["suffix", name], width).drop("total")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, t, n and field (row-major array of double): one row for each snapshot."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("run"), F.col("vec_id").alias("t"), F.lit(SIDE).alias("n"), v.alias("field"))


def cells(packed: DataFrame, column: str = "field") -> DataFrame:
    """run, t, i, j, v: one row for each cell."""
    flat = packed.select("run", "t", "n", F.posexplode(column).alias("p", "v"))
    return flat.select("run", "t", F.expr("p div n").cast("int").alias("i"), (F.col("p") % F.col("n")).alias("j"), "v")


def pack(cell_rows: DataFrame, n: int) -> DataFrame:
    """The inverse of ``cells``: a field's cells, gathered and put in order. A field is n * n cells, whatever the table's size."""
    ordered = F.array_sort(F.collect_list(F.struct((F.col("i") * n + F.col("j")).alias("p"), "v")))
    return cell_rows.groupBy("run", "t").agg(ordered.alias("c")).select("run", "t", F.lit(n).alias("n"), F.transform("c", lambda x: x["v"]).alias("field"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, tau0, split and n of each run; the last run is the test run."""
    runs = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("run")).agg(F.count("*").alias("snapshots"))
    last = F.max("run").over(Window.partitionBy())
    return runs.select("run", (0.1 + 0.05 * F.col("run")).alias("tau0"), F.when(F.col("run") == last, "test").otherwise("train").alias("split"), F.lit(SIDE).alias("n"), "snapshots")


def split_runs(manifest_rows: DataFrame, split: str) -> DataFrame:
    """Runs of a split; the names of a split in either spelling and any case."""
    names = {"train": ("train", "training"), "test": ("test", "heldout")}[split]
    return manifest_rows.where(F.lower("split").isin(*names))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, us (epoch microseconds), id and v of the irregular series in ``events``."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), us.alias("us"), F.col("event_id").alias("id"), F.col("value").alias("v"))


def estimates(packed: DataFrame) -> DataFrame:
    """run, t, n, x_true and the estimates x_b (the run's snapshot before), x_v, x_da and x_3 (between it and the truth)."""
    placed = preceded(packed.select("run", "t", "n", "field"), ["run"], "t", "field", "x_b")
    pairs = placed.select("run", "t", "n", F.col("field").alias("x_true"), "x_b").where("x_b is not null")
    between = lambda w: F.zip_with("x_true", "x_b", lambda a, b: w * a + (1 - w) * b)
    return pairs.withColumns({"x_v": between(0.25), "x_da": between(0.5), "x_3": between(0.75)})


def long_estimates(pairs: DataFrame) -> DataFrame:
    """run, t, n, x_true, method and x_est: a row for each estimate."""
    named = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("x_est")) for m, c in (("background", "x_b"), ("inverse", "x_v"), ("three_term", "x_3"), ("variational", "x_da"))])
    return pairs.select("run", "t", "n", "x_true", F.explode(named).alias("e")).select("run", "t", "n", "x_true", "e.method", "e.x_est")


def total(xs: Column) -> Column:
    """Sum of an array of double."""
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
