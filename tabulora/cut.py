"""Cuts of long plans: rows that several later steps read are written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir, or a local one on a single machine without that setting."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tabulora-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shared_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own beside the checkpoints, deleted at the end."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        _delete(spark, path)


#: Spark's own setting: shuffle files of an SQL execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def packed(df: DataFrame, at: str | None = None) -> DataFrame:
    """The same rows as compressed columns: a fraction of what cut takes of the disk, and the shuffles that made them go at
    once. They lie in the folder `at`, which goes when its owner says so, else beside the checkpoints until the end."""
    spark = df.sparkSession
    path = f"{at or checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    if at is None:
        atexit.register(_end, spark, path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _end(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session has ended
        pass


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder; later plans begin there and lost executors do not matter."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
