"""A Spark session with the settings this library is tested under."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", name: str = "fieldloom", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` override, with _ for . in their names."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    conf |= {k.replace("_", "."): v for k, v in settings.items()}
    return SparkSession.builder.master(master).appName(name).config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one of this machine where that is empty and Spark runs in one process (tests, a laptop)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that isn't there yet, in the shared one; what is written there goes when the driver ends."""
    folder = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the folder of ``spark.checkpoint.dir``: what is built on it begins there, whichever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
