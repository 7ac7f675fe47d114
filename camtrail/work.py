"""Tables between steps, kept where every machine can read them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return f"file://{tempfile.gettempdir()}/camtrail-shared"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's path, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    return path


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df computed once, as a table that survives lost executors; it goes when the driver ends."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own readers see them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@atexit.register
def _remove_kept() -> None:
    for spark, path in _KEPT:
        try:
            system, target = file_system(spark, path)
            system.delete(target, True)
        except Exception:  # the context may have ended; the folder is temporary either way
            return
