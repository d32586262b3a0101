"""Tables in the folder that all executors share: they cut a plan's lineage, survive a lost executor, and are computed once."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster has to name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "tallyfold-checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; delete_all() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def keep(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(*paths: str) -> None:
    """Remove folders from the file system that holds them."""
    jvm = SparkContext._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration() if SparkContext._active_spark_context is None else SparkContext._active_spark_context._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def delete_all() -> None:
    """Remove what this process has written by new_path(); runs at its end, since a lazy result may be read until then."""
    if _written and SparkContext._jvm is not None:
        try:
            delete(*_written)
        except Exception:  # the JVM may be gone before us; nothing else is left to do then  # noqa: BLE001
            pass
    _written.clear()


atexit.register(delete_all)
