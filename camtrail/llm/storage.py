"""Intermediate tables, written where every executor and the driver can read them."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from camtrail.work import file_system, shared_folder

_WRITTEN: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one table, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Arrow batches of at most so many bytes go to Python while a table is written.
ARROW_BYTES = 8 << 20


@contextmanager
def bounded_batches(spark: SparkSession, free: bool = False) -> Iterator[None]:
    """Arrow batches stay small while something is written. free: its shuffle files go at once."""
    before = {k: spark.conf.get(k) for k in (_FREE, _ARROW_BYTES)}
    try:
        spark.conf.set(_FREE, str(free or before[_FREE] == "true").lower())
        spark.conf.set(_ARROW_BYTES, str(ARROW_BYTES))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors. free: its shuffle files go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with bounded_batches(spark, free):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """A mark for free_but_last() and free_since()."""
    return len(_WRITTEN)


def free_but_last(mark: int) -> None:
    """Removes what was written since the mark but the last table, for when nothing that will still run reads the others."""
    for spark, path in _WRITTEN[mark:-1]:
        _remove(spark, path)
    del _WRITTEN[mark:-1]


def free_since(mark: int) -> None:
    """Removes all that was written since the mark."""
    for spark, path in _WRITTEN[mark:]:
        _remove(spark, path)
    del _WRITTEN[mark:]


def _remove(spark: SparkSession, path: str) -> None:
    system, target = file_system(spark, path)
    system.delete(target, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            _remove(spark, path)
        except Exception:  # the context may have ended; the folder is temporary either way
            return
