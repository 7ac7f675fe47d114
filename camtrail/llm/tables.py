"""How the queries read their tables, and small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file has fewer rows than 2 to this power.
FILE_ROWS_BITS = 40
#: Paths of files are broadcast up to so many bytes; longer lists are joined by a shuffle.
MOST_PATH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def numbered(docs: DataFrame, name: str = "row_id") -> DataFrame:
    """docs with a number for each row: unlike doc_id it is never null or repeated.

    It is the place of the row in its Parquet file and of the file among all, so every plan that reads the files gives a
    row the same number, however many cores read them. docs must come from Parquet files by select and where alone.
    """
    paths = sorted(set(docs.inputFiles()))
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if len(paths) < 2:
        return docs.select("*", index.alias(name))
    forms = [(form, i << FILE_ROWS_BITS) for i, p in enumerate(paths) for form in {p, p.replace("file:///", "file:/", 1)}]
    files = docs.sparkSession.createDataFrame(pa.table(dict(zip(("__path", "__first"), map(pa.array, zip(*forms))))))
    few = sum(len(form.encode()) for form, _ in forms) <= MOST_PATH_BYTES
    marked = docs.select("*", path.alias("__at"), index.alias("__index")).join(F.broadcast(files) if few else files.hint("merge"), F.col("__at") == F.col("__path"), "left")
    number = F.coalesce(F.col("__first"), F.raise_error(F.lit("a file that wasn't listed")).cast("long")) + F.col("__index")
    return marked.withColumn(name, number).drop("__at", "__index", "__path", "__first")


def without_rows(rows: DataFrame, gone: DataFrame, most: int = 2_000_000) -> DataFrame:
    """rows (with row_id) but those of a written table of row_id; few ids are broadcast, which leaves the texts in place."""
    few = gone.limit(most + 1).count() <= most
    return rows.join(F.broadcast(gone) if few else gone, "row_id", "left_anti")


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about most_bytes of the column, or a single row. At the end of them free memory goes back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        if values.nbytes <= most_bytes:
            yield batch
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Gives memory that this process has freed back to the system: Python workers outlive their tasks beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
