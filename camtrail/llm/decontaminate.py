"""Benchmark decontamination with a distributed positional inverted index (operator 6).

The index holds, for each term (hash of a word) that is looked for and each document, the term's positions, and the
number of words of every document. Each window of a benchmark item is looked up by its rarest terms, as counted over
all documents: the terms' postings, shifted by their offsets in the item, are intersected, which leaves alignments of
a document with an item. An alignment is then compared with the document's words, which gives the exact matches.

Items are held by the driver and the workers in blocks of bounded size; more blocks mean more passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camtrail.llm.storage import written
from camtrail.llm.tables import numbered, small_batches
from camtrail.llm.text_arrays import ALNUM, words_of

WINDOW = 13
RAREST = 2
#: Text of the items of a block: it bounds what is broadcast of them, three numbers a word.
BLOCK_BYTES = 4 << 20
#: So many alignments, with their documents, are broadcast at most; more are joined by a shuffle.
BROADCAST_ALIGNMENTS = 500_000
_INDEX_SCHEMA = "term long, row_id long, positions array<int>"
_HIT_SCHEMA = "row_id long, n_hit long, items array<string>"


@dataclass
class Items:
    """A block of benchmark items: ids, and their words as hashes."""

    ids: list[str]
    words: list[np.ndarray]

    @classmethod
    def of(cls, rows: list) -> Items:
        found = words_of(pa.array([r["text"] for r in rows], pa.string()), ALNUM)
        words = [found.hash[a:b] for a, b in zip(found.first[:-1], found.first[1:])]
        kept = [(str(r["item_id"]), w) for r, w in zip(rows, words) if len(w)]
        return cls([i for i, _ in kept], [w for _, w in kept])

    def terms(self) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))


class Lookup:
    """Where words stand in a sorted array of terms; most words are ruled out by their low bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.bits = max(16, int(len(terms)).bit_length() + 3)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._low(terms)] = True

    def _low(self, words: np.ndarray) -> np.ndarray:
        return (words & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words that are terms, and which terms they are."""
        at = np.flatnonzero(self.seen[self._low(words)])
        if not len(self.terms) or not len(at):
            return at[:0], at[:0]
        term = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        same = self.terms[term] == words[at]
        return at[same], term[same]


def term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the terms occurs in all texts."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = Lookup(held.value), np.zeros(len(held.value), np.int64)
        for batch in batches:
            for part in small_batches([batch], "text"):
                counts += np.bincount(lookup.find(words_of(part["text"], ALNUM).hash)[1], minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(found), pa.array(counts[found])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for row in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most one for each term of the block
        out[row["term"]] = row["n"]
    return out


def anchors(items: Items, terms: np.ndarray, counts: np.ndarray, window: int = WINDOW, rarest: int = RAREST) -> list[tuple[int, int, int]]:
    """(term hash as a signed integer, item, offset in the item): each window's rarest positions."""
    chosen = set()
    for k, words in enumerate(items.words):
        rank = counts[np.searchsorted(terms, words)]
        size = min(window, len(words))
        for start in range(len(words) - size + 1):
            order = np.argsort(rank[start : start + size], kind="stable")[:rarest]
            chosen.update((int(words[start + o].astype(np.int64)), k, start + int(o)) for o in order)
    return sorted(chosen)


def positional_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Postings of the terms over docs (row_id, text): term, row_id, positions. A row without a term holds the document's word count."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(held.value)
        for part in small_batches(batches, "text"):
            words, rows = words_of(part["text"], ALNUM), part["row_id"].to_numpy()
            at, term = lookup.find(words.hash)
            doc = np.searchsorted(words.first, at, "right") - 1
            order = np.lexsort((at, term, doc))
            at, term, doc = at[order], term[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])) if len(at) else at
            sizes = np.diff(words.first)
            offsets = np.concatenate([new, len(at) + np.arange(len(rows) + 1)])
            values = np.concatenate([at - words.first[doc], sizes]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            hashes = pa.array(np.concatenate([held.value[term[new]].astype(np.int64), np.zeros(len(rows), np.int64)]), mask=np.concatenate([np.zeros(len(new), bool), np.ones(len(rows), bool)]))
            yield pa.record_batch([hashes, pa.array(np.concatenate([rows[doc[new]], rows])), lists], ["term", "row_id", "positions"])

    return docs.select("row_id", "text").mapInArrow(run, _INDEX_SCHEMA)


def alignments(index: DataFrame, chosen: list[tuple[int, int, int]], items: Items, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """row_id, and as a list the items with the position in the document at which the item would start.

    An alignment is kept where as many postings meet as its windows look up at least.
    """
    spark = index.sparkSession
    columns = [pa.array(c, t) for c, t in zip(zip(*chosen) if chosen else ((), (), ()), (pa.int64(), pa.int32(), pa.int32()))]
    looked = F.broadcast(spark.createDataFrame(pa.table(columns, ["term", "item", "offset"])))  # no more rows than the block has words
    least = min([rarest, *map(len, items.words)])
    met = (
        index.where("term is not null").join(looked, "term")
        .select("row_id", "item", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("shift"))
        .groupBy("row_id", "item", "shift").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    )
    return met.groupBy("row_id").agg(F.collect_list(F.struct("item", "shift")).alias("alignments"))


def _matched(words: np.ndarray, item: np.ndarray, shift: int, window: int) -> list[tuple[int, int]]:
    """Ranges of document words where the item, laid at shift, matches over a window or more."""
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    if high <= low:
        return []
    same = np.concatenate([[False], item[low:high] == words[shift + low : shift + high], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    size = min(window, len(item))
    return [(shift + low + int(a), shift + low + int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= size]


def _covered(ranges: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(ranges):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def exact_matches(docs: DataFrame, found: DataFrame, items: Items, window: int = WINDOW) -> DataFrame:
    """row_id, n_hit and the items' ids of each aligned document that has matches."""
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for part in small_batches(batches, "text"):
            words, out = words_of(part["text"], ALNUM), []
            for i, (row_id, aligned) in enumerate(zip(part["row_id"].to_pylist(), part["alignments"].to_pylist())):
                own, ranges, ids = words.hash[words.first[i] : words.first[i + 1]], [], set()
                for a in aligned:
                    if new := _matched(own, block.words[a["item"]], a["shift"], window):
                        ranges += new
                        ids.add(block.ids[a["item"]])
                if ids:
                    out.append((row_id, [x for r in ranges for x in r], sorted(ids)))
            rows, flat, names = zip(*out) if out else ((), (), ())
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(flat, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["row_id", "ranges", "items"])

    few = (found.agg(F.sum(1 + F.size("alignments"))).first()[0] or 0) <= BROADCAST_ALIGNMENTS
    pairs = docs.select("row_id", "text").join(F.broadcast(found) if few else found, "row_id")
    return pairs.mapInArrow(run, "row_id long, ranges array<long>, items array<string>")


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = []
        for lists in batch["ranges"].to_pylist():
            flat = [x for one in lists for x in one]
            hits.append(_covered(list(zip(flat[::2], flat[1::2]))))
        yield pa.record_batch([batch["row_id"], pa.array(hits, pa.int64()), batch["items"]], ["row_id", "n_hit", "items"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """row_id, doc_id, n_words, n_hit and items (ids as strings, sorted) of every row of docs (doc_id, text).

    A word is hit that lies in an occurrence of `window` consecutive words of an item, or of all words of a shorter
    item. Texts that are null or empty have no words; items without words, text or id match nothing; items that share
    an id count once. Repeated rows give repeated results; an empty table gives none. docs is read from files.
    """
    rows = numbered(docs.select("doc_id", "text"))
    given = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    matches, sizes = [], None
    for block in range(blocks):
        part = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else given
        held = Items.of(part.collect())  # about BLOCK_BYTES
        terms = held.terms()
        chosen = anchors(held, terms, term_counts(rows, terms), window)
        looked = np.unique(np.array([t for t, _, _ in chosen], np.int64).astype(np.uint64))
        index = written(positional_index(rows, looked), "postings")
        if sizes is None:
            sizes = index.where("term is null").select("row_id", F.col("positions")[0].cast("long").alias("n_words"))
        found = written(alignments(index, chosen, held, window), "alignments")
        matches.append(exact_matches(rows, found, held, window))
    merged = reduce(DataFrame.unionByName, matches).groupBy("row_id").agg(F.collect_list("ranges").alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = merged.mapInArrow(_summed, _HIT_SCHEMA)
    return (
        rows.select("row_id", "doc_id").join(sizes, "row_id").join(hits, "row_id", "left")
        .select("row_id", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def contaminated() -> Column:
    """Whether a document counts as contaminated: a twentieth of its words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def proximity(index: DataFrame, terms: list[int], distance: int) -> DataFrame:
    """row_id and position of the first term wherever all other terms of an index lie within distance words of it."""
    first = index.where(F.col("term") == terms[0]).select("row_id", F.explode("positions").alias("position"))
    for term in terms[1:]:
        other = index.where(F.col("term") == term).select("row_id", F.col("positions").alias("others"))
        near = F.exists("others", lambda p: F.abs(p - F.col("position")) <= distance)
        first = first.join(other, "row_id").where(near).select("row_id", "position")
    return first
