"""Session helpers shared by every subpackage: shipping code, cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "spark.wattloom.shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_wattloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="wattloom-"), "wattloom")
    archive = shutil.make_archive(out, "zip", root, "wattloom")
    sc.addPyFile(archive)
    sc._wattloom_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset a temporary one
    stands in, on a local master alone: elsewhere it would not be shared."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written tables beside the checkpoints, deleted when the driver ends:
    results that read it stay valid until then."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone before
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)

    atexit.register(remove)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and continue from reliable files in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, rows: int, each: int = 10_000) -> DataFrame:
    """df, which has at most so many rows, in no more tasks than they need. Every task of a
    shuffle or a checkpoint leaves files and a record in the driver, so that a small table in
    very many tasks takes more disk and memory for them than for its rows. A large table
    stays as it is."""
    return df.coalesce(max(24, -(-rows // each)))
