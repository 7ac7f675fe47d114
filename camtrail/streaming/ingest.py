"""Incremental ingest of stored analyses: a file stream into a history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from camtrail.sources.history import History
from camtrail.sources.results import parsed


def result_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Whole analyses of the files that arrive in a folder, with the time they were written; others are skipped."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    return parsed(files.select("value", F.col("_metadata.file_modification_time").alias("saved_at")))


def ingest(spark: SparkSession, folder: str, history: str, checkpoint: str) -> None:
    """Takes in what is new in the folder and ends. Each batch is added once, by the number that the checkpoint gives it; nothing older is written again.

    A history takes batches of one checkpoint.
    """
    kept = History(spark, history)

    def add(batch: DataFrame, number: int) -> None:
        kept.append(batch, name=f"stream-{number:012d}")

    stream = result_stream(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
