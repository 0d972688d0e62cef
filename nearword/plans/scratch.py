"""Folders for what a plan must write and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, without a slash at its end.

    Where it is unset, a temporary one is made and set, for a local session only: executors of a cluster
    don't share the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nearword-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one. It is removed when this process ends, or by :func:`clear`."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: later plans start from its files and survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(spark: SparkSession, path: str):
    """(file system of a path, the function that makes its paths)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def remove(spark: SparkSession, path: str) -> None:
    files, made = store(spark, path)
    files.delete(made(path), True)


def clear() -> None:
    """Remove the folders that this process made, of results that were read."""
    for path, spark in list(_made.items()):
        del _made[path]
        if path.startswith("file:"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        elif spark.sparkContext._jsc is not None:  # those of a stopped session can't be reached any more
            remove(spark, path)


atexit.register(clear)
