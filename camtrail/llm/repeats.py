"""Removal of repeated byte strings by bucket-pointer refinement (operator 8).

A byte goes if it lies in a string of `length` bytes that also starts earlier. Positions have bucket identifiers, as in
bucket-pointer refinement of suffixes: the first buckets are 8-grams, and a level's buckets are split by the identifier
that the level before gave to the bucket at a later offset, so that each level's identifiers are used again for the
next, of twice the width. An identifier is the hash of the two that it comes from, not a rank among all: positions
of equal stretches get equal ones on every machine, without a sort of all suffixes at each level.

1. Every string holds an anchor, the q-gram of least identifier in it (leftmost of equals), so equal strings share
   their anchor's q-gram and its offset. Only buckets of anchors, a few hundredths of all positions, are shuffled. A
   unit is an anchor with the run of strings that it anchors.
2. A bucket is refined by the identifiers of later offsets that cover the unit's whole stretch. Units alike in it hold
   the same strings: all but the first are removed. A bucket that is not split by this is done with.
3. The units of split buckets are cut into runs of RUN strings, aligned to the anchor. Their buckets are what all
   strings of a run have in common, at its offset from the anchor; runs are then compared as units were, and most
   buckets hold one run now.
4. In buckets that are still split every single string is compared, and all but the first of each are removed.

Before each shuffle a batch keeps one unit, or string, of those alike, and one row for each bucket that it has split
itself: a passage that a third of all documents share sends a few rows a batch. Nothing is capped or sampled. Units
and strings are compared inside a bucket alone, so two that differ are taken for one only if two 64-bit identifiers
agree, of which one covers the whole string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from camtrail.llm.storage import written
from camtrail.llm.tables import numbered, small_batches
from camtrail.llm.text_arrays import joined, mixed

LENGTH = 100
GRAM = 32
RUN = 8
BATCH_BYTES = 24 << 20
STRING_BATCH_BYTES = 6 << 20
#: Row numbers that are broadcast at most, about 30 MB; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_PIECE = 1 << 16
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
#: state: 0 a unit to be compared by bucket, 1 a sign that a bucket is split, 2 a unit of a split bucket, 3 removed.
_UNIT_SCHEMA = "bucket long, stretch long, doc_id long, row_id long, low long, high long, lead int, state byte"
_STRING_SCHEMA = "bucket long, string long, doc_id long, row_id long, low long, high long"
UNIT, SIGN, SPLIT, REMOVED = range(4)


def _refined_by(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of buckets split by the identifiers of the buckets at a later offset."""
    return mixed(bucket * _FACTOR + later)


class Buckets:
    """Bucket identifiers of the positions of a byte array, by the stretch of a given width that starts there."""

    def __init__(self, data: np.ndarray):
        self._levels = {1: data.astype(np.uint64)}

    def _level(self, width: int) -> np.ndarray:
        """Of all positions; width is a power of 2. Up to 8 bytes are their own identifier."""
        if width not in self._levels:
            half = width // 2
            before = self._level(half)
            near, far = before[: max(0, len(before) - half)], before[half:]
            self._levels[width] = near | far << np.uint64(8 * half) if width <= 8 else _refined_by(mixed(near) if half == 8 else near, far)
        return self._levels[width]

    def all(self, width: int) -> np.ndarray:
        """Identifiers of every position with width bytes from it on."""
        wide = 1 << (width.bit_length() - 1)
        level = self._level(wide)
        if width > wide:
            return _refined_by(mixed(level[: max(0, len(level) - width + wide)]), level[width - wide :])
        return mixed(level)

    def at(self, positions: np.ndarray, width: int) -> np.ndarray:
        """Identifiers of some positions. Levels that no call has made for all positions are made for these alone."""
        wide = 1 << (width.bit_length() - 1)
        if width > wide:
            return _refined_by(mixed(self._made(positions, wide)), self._made(positions + (width - wide), wide))
        return mixed(self._made(positions, wide))

    def _made(self, positions: np.ndarray, width: int) -> np.ndarray:
        if width <= 16 or width in self._levels:
            return self._level(width)[positions]
        return _refined_by(self._made(positions, width // 2), self._made(positions + width // 2, width // 2))

    def between(self, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
        """Identifiers of stretches of a width to twice that."""
        return _refined_by(_refined_by(self.at(start, width), self.at(end - width, width)), (end - start).astype(np.uint64))


def units_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Bucket, stretch identifier, first and last string start and the last one's distance to the anchor, of each unit. Texts are as joined() has them."""
    grams = length - gram + 1
    found = []
    for low in range(0, len(data) - length, _PIECE):  # the last byte is a separator
        part = data[low : low + _PIECE + length - 1]
        buckets = Buckets(part)
        ids = buckets.all(gram)
        at = np.arange(len(ids))
        least = (ids & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        width = 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        # a string lies in one text, without the separator after it
        starts = np.arange(low, low + len(anchor))
        text = np.searchsorted(offsets, starts, "right")
        valid = starts + length < offsets[np.minimum(text, len(offsets) - 1)]
        edge = np.flatnonzero(valid[1:] != valid[:-1]) + 1
        first = np.union1d(first, edge)
        last = np.append(first[1:], len(anchor)) - 1
        keep = valid[first]
        first, last = first[keep], last[keep]
        found.append((ids[anchor[first]], buckets.between(first, last + length, length), first + low, last + low, anchor[first] - last))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _gathered(batches: Iterable[pa.RecordBatch], columns: list[str], most: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Tables of about so many bytes, or of one text."""
    held, size = [], 0
    for part in small_batches(batches, "text", most):
        part = part.select(columns)
        if held and size + part.nbytes > most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(part)
        size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _in_order(part: pa.Table) -> pa.Table:
    return part.sort_by([("doc_id", "ascending"), ("row_id", "ascending")])


def _merged(text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of ranges, text by text."""
    order = np.lexsort((low, text))
    text, low, high = text[order], low[order], high[order]
    if not len(low):
        return text, low, high
    shift = text * (1 << 40)  # so that ranges of different texts are apart
    reach = np.maximum.accumulate(high + shift)
    new = np.concatenate([[True], (low + shift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return text[first], low[first], reach[np.append(first[1:], len(low)) - 1] - shift[first]


def runs_of(data: np.ndarray, low: np.ndarray, high: np.ndarray, lead: np.ndarray, length: int, run: int) -> tuple[np.ndarray, ...]:
    """Units, given by first and last string start and lead, cut into runs; as units_of() gives units."""
    anchor, far = high + lead, lead + high - low  # distances to the anchor go from lead to far
    pieces = far // run - lead // run + 1
    of = np.repeat(np.arange(len(low)), pieces)
    piece = lead[of] // run + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    near, away = np.maximum(lead[of], piece * run), np.minimum(far[of], piece * run + run - 1)
    first, last = anchor[of] - away, anchor[of] - near
    # what every string at such a distance holds: from the nearest one's start to the farthest one's end
    core = anchor[of] - piece * run
    bucket = _by_pieces(data, core, length - run + 1, lambda buckets, at, _: buckets.at(at, length - run + 1))
    stretch = _by_pieces(data, first, 2 * length, lambda buckets, at, of: buckets.between(at, at + (last - first)[of] + length, length))
    return mixed(bucket + piece.astype(np.uint64)), stretch, first, last, near


def _settled(part: pa.Table, offsets: np.ndarray, units: tuple[np.ndarray, ...], length: int) -> pa.RecordBatch:
    """Rows for the units of a batch, compared with each other."""
    bucket, stretch, low, high, lead = units
    order = np.lexsort((low, stretch, bucket))
    bucket, stretch, low, high, lead = (x[order] for x in (bucket, stretch, low, high, lead))
    new_bucket = np.ones(len(low), bool)
    new_bucket[1:] = bucket[1:] != bucket[:-1]
    first = new_bucket.copy()
    first[1:] |= stretch[1:] != stretch[:-1]
    group = np.cumsum(new_bucket) - 1
    split = (np.bincount(group, weights=first) > 1)[group] if len(low) else new_bucket
    text = np.searchsorted(offsets, low, "right") - 1
    low, high = low - offsets[text], high - offsets[text]
    gone = _merged(text[~first], low[~first], high[~first] + length)
    # what is settled here gets a bucket of its own, for an even shuffle
    own = lambda t, x: mixed((t.astype(np.uint64) << np.uint64(40)) + x.astype(np.uint64))
    rows = [[x[chosen] for x in (bucket, stretch, text, low, high, lead)] for chosen in (first & ~split, new_bucket & split, first & split)]
    rows[SPLIT][0] = own(text[first & split], low[first & split])
    rows.append([own(gone[0], gone[1]), gone[1].astype(np.uint64), *gone, np.zeros_like(gone[0])])
    states = np.repeat(np.arange(4, dtype=np.int8), [len(r[0]) for r in rows])
    bucket, stretch, text, low, high, lead = (np.concatenate(c) for c in zip(*rows))
    doc_id, row_id = (part[c].combine_chunks().take(pa.array(text)) for c in ("doc_id", "row_id"))
    arrays = [pa.array(bucket.view(np.int64)), pa.array(stretch.view(np.int64)), doc_id, row_id, pa.array(low), pa.array(high), pa.array(lead.astype(np.int32)), pa.array(states)]
    return pa.record_batch(arrays, ["bucket", "stretch", "doc_id", "row_id", "low", "high", "lead", "state"])


def _find_units(length: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches, ["doc_id", "row_id", "text"]):
            part = _in_order(part)
            data, offsets = joined(part["text"])
            yield _settled(part, offsets, units_of(data, offsets, length, gram), length)

    return run


def _listed(part: pa.Table, offsets: np.ndarray) -> list[np.ndarray]:
    """first and last string start and lead of the units listed for the texts of a batch."""
    lists = part["units"].combine_chunks()
    at = np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy()))
    low, high, lead = (lists.flatten().field(n).to_numpy() for n in ("low", "high", "lead"))
    return [low + at, high + at, lead.astype(np.int64)]


def _find_runs(length: int, run_length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches, ["doc_id", "row_id", "text", "units"]):
            part = _in_order(part)
            data, offsets = joined(part["text"])
            yield _settled(part, offsets, runs_of(data, *_listed(part, offsets), length, run_length), length)

    return run


def _refined(units: DataFrame, length: int) -> DataFrame:
    """Units of split buckets (SPLIT) and removed ranges (REMOVED); what is first or alone in its bucket is left out."""
    settled = F.col("state") >= SPLIT
    whole = Window.partitionBy("bucket", settled)
    split = (F.max("state").over(whole) == SIGN) | (F.min("stretch").over(whole) != F.max("stretch").over(whole))
    place = F.row_number().over(Window.partitionBy("bucket", settled).orderBy("doc_id", "row_id", "low"))
    later = (F.col("state") == UNIT) & ~F.col("split") & (F.col("place") > 1)
    return (
        units.withColumns({"split": split, "place": place})
        .select(
            "row_id", "low", F.when(later, F.col("high") + length).otherwise(F.col("high")).alias("high"), "lead",
            F.when(settled, F.col("state")).when((F.col("state") == UNIT) & F.col("split"), SPLIT).when(later, REMOVED).cast("byte").alias("state"),
        )
        .where("state is not null")
    )


def _find_strings(length: int, gram: int):
    """The single strings of listed units: one row for each that is new in the batch, ranges for the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches, ["doc_id", "row_id", "text", "units"], STRING_BATCH_BYTES):
            part = _in_order(part)
            data, offsets = joined(part["text"])
            low, high, lead = _listed(part, offsets)
            sizes = high - low + 1
            at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            at, first = np.unique(at, return_index=True)
            anchor = np.repeat(high + lead, sizes)[first]
            bucket = _refined_by(_by_pieces(data, anchor, gram, lambda buckets, x, _: buckets.at(x, gram)), (anchor - at).astype(np.uint64))
            ids = _by_pieces(data, at, length, lambda buckets, x, _: buckets.at(x, length))
            order = np.lexsort((at, ids, bucket))
            bucket, ids, at = bucket[order], ids[order], at[order]
            first = np.concatenate([[True], (ids[1:] != ids[:-1]) | (bucket[1:] != bucket[:-1])]) if len(ids) else np.zeros(0, bool)
            text = np.searchsorted(offsets, at, "right") - 1
            own = at - offsets[text]
            gone = _merged(text[~first], own[~first], own[~first] + length)
            text, low = np.concatenate([text[first], gone[0]]), np.concatenate([own[first], gone[1]])
            high = np.concatenate([np.zeros(first.sum(), np.int64), gone[2]])
            spread = mixed((gone[0].astype(np.uint64) << np.uint64(40)) + gone[1].astype(np.uint64))
            keys = [pa.array(np.concatenate([x[first], spread]).view(np.int64)) for x in (bucket, ids)]
            doc_id, row_id = (part[c].combine_chunks().take(pa.array(text)) for c in ("doc_id", "row_id"))
            yield pa.record_batch([*keys, doc_id, row_id, pa.array(low), pa.array(high)], ["bucket", "string", "doc_id", "row_id", "low", "high"])

    return run


def _by_pieces(data: np.ndarray, start: np.ndarray, most: int, made) -> np.ndarray:
    """made(buckets, positions, which of start) for all of start, piece by piece; stretches have most bytes at most."""
    order = np.argsort(start, kind="stable")
    ordered, out, i = start[order], np.empty(len(start), np.uint64), 0
    while i < len(ordered):
        low = ordered[i]
        j = int(np.searchsorted(ordered, low + _PIECE))
        out[order[i:j]] = made(Buckets(data[low : ordered[j - 1] + most]), ordered[i:j] - low, order[i:j])
        i = j
    return out


def with_lists(rows: DataFrame, ranges: DataFrame, name: str, *columns: str) -> DataFrame:
    """rows (with text) that have ranges, with the list of them; texts without any are not shuffled if the others are few."""
    lists = ranges.groupBy("row_id").agg(F.collect_list(F.struct("low", "high", *columns)).alias(name))  # at most as many as a text has bytes
    ids = ranges.select("row_id").distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(ids), "row_id", "left_semi")
    return rows.join(lists, "row_id")


def _kept(text: str, ranges: list[dict]) -> tuple[list[tuple[int, int]], bytes]:
    data, merged = (text or "").encode(), []
    for low, high in sorted((r["low"], r["high"]) for r in ranges):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    at, out = 0, []
    for low, high in merged:
        out.append(data[at:low])
        at = high
    return merged, b"".join([*out, data[at:]])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in small_batches(batches, "text"):
        done = [_kept(t, r) for t, r in zip(part["text"].to_pylist(), part["ranges"].to_pylist())]
        spans = pa.array([[{"low": a, "high": b} for a, b in m] for m, _ in done], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
        removed = pa.array([sum(b - a for a, b in m) for m, _ in done], pa.int64())
        yield pa.record_batch(
            [part["row_id"], removed, spans, pa.array([k for _, k in done], pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for _, k in done])],
            ["row_id", "n_removed", "removed", "kept", "kept_sha256"],
        )


def repeated_ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row_id, low and high (exclusive) of byte ranges that together cover what is to be removed from rows (doc_id, row_id, text)."""
    units = written(_refined(rows.mapInArrow(_find_units(length, gram), _UNIT_SCHEMA), length), "units")
    listed = with_lists(rows, units.where(F.col("state") == SPLIT), "units", "lead")
    runs = written(_refined(listed.mapInArrow(_find_runs(length, min(RUN, length)), _UNIT_SCHEMA), length), "runs")
    removed = units.unionByName(runs).where(F.col("state") == REMOVED).select("row_id", "low", "high")
    listed = with_lists(rows, runs.where(F.col("state") == SPLIT), "units", "lead")
    strings = listed.mapInArrow(_find_strings(length, gram), _STRING_SCHEMA)
    settled = F.col("high") > 0
    place = F.row_number().over(Window.partitionBy("bucket", "string", settled).orderBy("doc_id", "row_id", "low"))
    later = strings.withColumn("place", place).where(settled | (F.col("place") > 1))
    return removed.unionByName(later.select("row_id", "low", F.when(settled, F.col("high")).otherwise(F.col("low") + length).alias("high")))


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row_id, doc_id, n_bytes, n_removed, removed (maximal ranges), kept (bytes) and kept_sha256 of each row of docs (doc_id, text).

    Documents come in the order of doc_id, null first; rows that repeat a doc_id count as documents of their own, in
    the order of the input. Null texts count as empty: nothing to remove. An empty table gives none. docs is read
    from files.
    """
    rows = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    ranges = written(repeated_ranges(rows, length, gram), "ranges")
    spans = "array<struct<low:long,high:long>>"
    cut = with_lists(rows.select("row_id", "text"), ranges, "ranges").mapInArrow(_cut, f"row_id long, n_removed long, removed {spans}, kept binary, kept_sha256 string")
    return rows.join(cut.withColumnRenamed("kept_sha256", "cut_sha256"), "row_id", "left").select(
        "row_id", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed", F.array().cast(spans)).alias("removed"), F.coalesce("kept", F.encode("text", "UTF-8")).alias("kept"),
        F.coalesce("cut_sha256", F.sha2("text", 256)).alias("kept_sha256"),
    )
