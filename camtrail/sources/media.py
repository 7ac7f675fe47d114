"""Media files and their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from camtrail.functions.text import new_media_id, upload_suffix


def media_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, name, suffix and content of the files of a folder; content is read only where it is selected. Empty files give no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), upload_suffix(name).alias("suffix"), "content")


def uploads(media: DataFrame) -> DataFrame:
    """Adds saved_name, the media_id with the upload's suffix, to media (media_id, source_name)."""
    return media.withColumn("saved_name", F.concat("media_id", upload_suffix(F.col("source_name"))))


def new_uploads(named: DataFrame) -> DataFrame:
    """Adds a new media_id, and saved_name, to rows of source_name. Write the result before it is read twice: ids differ each time."""
    return uploads(named.withColumn("media_id", new_media_id()))
