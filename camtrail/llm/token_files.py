"""Token ids in Parquet files, for selective reads (operator 3).

File format: one row a document in ascending doc_id order over all files (range partitioned, so each file holds its
own range of doc_id), with the ids as a list of 32-bit integers. Ids are dictionary encoded, as a chunk uses few of
the vocabulary; the integers beside them are delta encoded (version 2 pages). Row groups and pages are bounded, and
the page indexes, on by default, let readers skip pages by doc_id and read metadata without the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from camtrail.llm.bpe_words import library_bpe
from camtrail.llm.tables import small_batches

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 512
BROADCAST_FILES = 1_000_000


def _encode(model: str, end_id: int):
    """Ids of each text with end_id after them, and how many ids of the partition come before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part, total = library_bpe(model), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in small_batches(batches, "text", 2 << 20):
            encoded = [bpe.encode(text) + end for text in batch["text"].to_pylist()]
            counts = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
            offsets = np.concatenate([[0], np.cumsum(counts)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
            yield pa.record_batch(
                [batch["doc_id"], pa.array(np.full(len(encoded), part), pa.int32()), pa.array(offsets[:-1] + total), pa.array(counts), ids],
                ["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            total += int(offsets[-1])

    return run


def write_tokens(docs: DataFrame, path: str, model: str, end_id: int = 0, partitions: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes the files to path.

    A null text is empty: its row holds end_id alone. Rows with a null doc_id come first. Rows that repeat a doc_id
    stay, in the order of their texts' hashes. An empty table gives files without rows. Further columns, of whatever
    names, are ignored. There are as many files as the input has splits, or as a shuffle has partitions if that is more.
    """
    spark = docs.sparkSession
    partitions = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    (
        ordered.mapInArrow(_encode(model, end_id), FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids; first and last bound doc_id and skip files and pages.

    Columns that are not selected are not read: metadata reads leave the ids alone. Rows with a null doc_id lie outside
    of any bounds. Files without rows give none.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    few = sizes.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES  # else the join shuffles the ids
    chosen = files
    if first is not None:
        chosen = chosen.where(F.col("doc_id") >= first)
    if last is not None:
        chosen = chosen.where(F.col("doc_id") <= last)
    return chosen.join(F.broadcast(bases) if few else bases, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        values = ids.values.to_numpy().astype("<u4", copy=False)
        ends = ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.record_batch([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers; a row for each of tokens."""
    return tokens.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
