"""Token counts of whole documents, with overlap resynchronisation for huge ones (operator 4).

A document longer than a chunk is cut into chunks that overlap, and the chunks are encoded apart, on any executor.
The pre-tokeniser has no memory: what follows a pre-token's start depends on the text from there on alone. So a start
common to two encodings of the overlap is proven stable: both continue alike from it, and the left chunk, right up to
the end of its text but for a short tail that the cut may change, vouches for it. The counts are spliced there.
Where an overlap holds no common start (one endless word, say) the document is done again with wider overlaps, until
they span it.

Nulls count as empty texts; every input row gives one row, repeated rows too; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from camtrail.llm.bpe_words import library_bpe
from camtrail.llm.storage import written
from camtrail.llm.tables import numbered, small_batches

CHUNK = 16_384
OVERLAP = 512
WIDEN = 8
_CHUNK_SCHEMA = "row_id long, k int, last boolean, start long, text string"
_PART_SCHEMA = "row_id long, k int, last boolean, n_tokens long, head array<long>, head_before array<long>, tail array<long>, tail_before array<long>"


def _whole(model: str):
    """Counts texts in one piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = library_bpe(model)
        for batch in small_batches(batches, "text"):
            counts = [len(bpe.encode(text)) // 4 for text in batch["text"].to_pylist()]
            yield pa.record_batch([batch["row_id"], pa.array(counts, pa.int64())], ["row_id", "n_tokens"])

    return run


def _cut(chunk: int, overlap: int):
    """Chunk k of a text is [k * chunk, (k + 1) * chunk + overlap)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row_id, text in zip(batch["row_id"].to_pylist(), batch["text"].to_pylist()):
                starts = range(0, max(1, len(text) - overlap), chunk)
                for k, start in enumerate(starts):
                    last = k == len(starts) - 1
                    piece = text[start:] if last else text[start : start + chunk + overlap]
                    yield pa.record_batch([pa.array([row_id], pa.int64()), pa.array([k], pa.int32()), pa.array([last]), pa.array([start], pa.int64()), pa.array([piece])], ["row_id", "k", "last", "start", "text"])

    return run


def _encode_chunks(model: str, chunk: int, overlap: int):
    """For each chunk: its tokens, and the pre-token starts in the overlaps at its head and tail with the tokens before each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = library_bpe(model)
        # the cut can change the last pre-token, the one before it by look-ahead, and the string of an added token
        unsure = 2 + max([0, *map(len, bpe.added)])
        for batch in batches:
            rows: list[tuple] = []
            for row_id, k, last, start, text in zip(*(batch[c].to_pylist() for c in ("row_id", "k", "last", "start", "text"))):
                at, counts = bpe.pieces(text)
                before = np.cumsum(counts) - counts
                head = slice(0, int(np.searchsorted(at, overlap))) if k else slice(0, 0)
                # a pre-token ends where the next starts: the starts of those that end before the unsure tail are right
                sure = at[: int(np.searchsorted(np.append(at[1:], len(text)), len(text) - unsure))] if not last else at[:0]
                tail = slice(int(np.searchsorted(sure, chunk)), len(sure))
                rows.append((row_id, k, last, int(counts.sum()), at[head] + start, before[head], at[tail] + start, before[tail]))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64()] + [pa.list_(pa.int64())] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["row_id", "k", "last", "n_tokens", "head", "head_before", "tail", "tail_before"])

    return run


def spliced(parts: DataFrame) -> DataFrame:
    """row_id and n_tokens of each document; n_tokens is null where two neighbours share no stable start."""
    following = Window.partitionBy("row_id").orderBy("k")
    joined = parts.withColumns({"next_head": F.lead("head").over(following), "next_before": F.lead("head_before").over(following)})
    common = F.array_min(F.array_intersect("tail", "next_head"))
    place = lambda positions, before: F.get(F.col(before), F.array_position(positions, F.col("common")).cast("int") - 1)
    ends = joined.withColumn("common", common).select(
        "row_id", "k", "last",
        F.when(F.col("last"), F.col("n_tokens")).otherwise(place("tail", "tail_before")).alias("until"),
        F.when(F.col("last"), F.lit(0)).otherwise(place("next_head", "next_before")).alias("skipped"),
    )
    whole = F.sum(F.col("until") - F.col("skipped"))
    return ends.groupBy("row_id").agg(F.when(F.bool_and(F.col("until").isNotNull()), whole).alias("n_tokens"))


def token_counts(docs: DataFrame, model: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row_id, doc_id, n_bytes and n_tokens of every row of docs (doc_id, text).

    A null or empty text has no bytes and no tokens; repeated rows are counted each; an empty table gives none. Further
    columns, of whatever names, are ignored. docs is read from files. model: path of a tokenizers file that every executor can read.
    """
    rows = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    sizes = rows.select("row_id", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    long = F.length("text") > chunk + overlap
    found = [written(rows.where(~long).select("row_id", "text").mapInArrow(_whole(model), "row_id long, n_tokens long"), "counts")]
    pending = rows.where(long).select("row_id", "text")
    while True:
        # a document is cut only if it is longer than chunk and overlap together: at last it is one chunk
        parts = pending.mapInArrow(_cut(chunk, overlap), _CHUNK_SCHEMA).repartition("row_id", "k").mapInArrow(_encode_chunks(model, chunk, overlap), _PART_SCHEMA)
        counted = written(spliced(parts), "counts")
        found.append(counted.where("n_tokens is not null"))
        failed = counted.where("n_tokens is null").select("row_id")
        if failed.isEmpty():
            break
        pending, overlap = pending.join(failed, "row_id", "left_semi"), overlap * WIDEN
    return sizes.join(reduce(DataFrame.unionByName, found), "row_id")
