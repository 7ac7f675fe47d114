"""Ranked lexical search by Fagin's threshold algorithm (operator 11).

Items (the queries) are held in blocks of bounded size. Of every document a forward index keeps its length and how often it
holds each term of the block. From it come the statistics of the whole collection, and, once these are known, the lists:
each task takes the documents of its partition shard by shard, turns a shard's forward index into a list for each term, sorted by
impact (the term's score in a document, highest first), and runs the algorithm for each item. It reads the lists of the
item's terms in turn, some entries deeper each round, looks the documents up that it meets for the first time in the
forward index, which gives their whole score, and ends once the threshold, the score of a document that would stand in every
list where reading stopped, is strictly below the k-th best score. The best of a task's earlier shards count there, so
later shards end sooner. Each task gives k documents an item, and the best k of them stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from camtrail.llm.decontaminate import Lookup
from camtrail.llm.storage import written
from camtrail.llm.tables import give_back, small_batches
from camtrail.llm.text_arrays import ALNUM, words_of

# Fixed values of the score.
TOP, SCALE, WEIGHT_SCALE, LENGTH_SHARE, SATURATION = 20, 1_000_000_000, 1000, 25, 12
#: Text of the items of a block; each block reads all documents.
BLOCK_BYTES = 4 << 20
#: Postings of a shard, or one document.
SHARD_POSTINGS = 1 << 20
#: Entries read from each list in the first round; twice as many in each next.
FIRST_ROUND = 8
_NO_ID = np.iinfo(np.int64).max
_FORWARD = "doc_id long, n long, terms array<int>, counts array<int>"


@dataclass
class Queries:
    """terms: distinct hashes of a block's terms; of each item its id and its distinct terms' places and counts."""

    ids: list
    terms: np.ndarray
    own: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list) -> Queries:
        found = words_of(pa.array([r["text"] for r in rows], pa.string()), ALNUM)
        parts = [found.hash[a:z] for a, z in zip(found.first, found.first[1:])]
        terms = np.unique(found.hash)
        counted = [np.unique(p, return_counts=True) for p in parts]
        return cls([r["item_id"] for r in rows], terms, [(np.searchsorted(terms, t), n) for t, n in counted])


def forward_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, n (terms in all), and the places in `terms` of those that the text holds, with their counts. Texts without terms are left out."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(held.value)
        for batch in small_batches(batches, "text"):
            words = words_of(batch["text"], ALNUM)
            at, term = lookup.find(words.hash)
            doc = np.searchsorted(words.first, at, "right") - 1
            keys, counts = np.unique(doc * len(lookup.terms) + term, return_counts=True)
            doc, term = np.divmod(keys, max(1, len(lookup.terms)))
            offsets = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (term, counts)]
            n = np.diff(words.first)
            made = pa.record_batch([batch["doc_id"], pa.array(n), *lists], ["doc_id", "n", "terms", "counts"])
            yield made.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, _FORWARD)


@dataclass
class Statistics:
    n_docs: int
    n_terms: int
    weights: np.ndarray

    @classmethod
    def of(cls, forward: DataFrame, size: int) -> Statistics:
        """N and L of all documents, and the weights of a block's terms; a task gives one row a term at most."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(size, np.int64)
            for batch in batches:
                found += np.bincount(batch["terms"].flatten().to_numpy(), minlength=size)
            held = np.flatnonzero(found)
            yield pa.record_batch([pa.array(held), pa.array(found[held])], ["term", "df"])

        n_docs, n_terms = forward.agg(F.count(F.lit(1)), F.sum("n")).first()
        weights = np.zeros(size, np.int64)
        for row in forward.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the block's terms
            weights[row["term"]] = math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
        return cls(n_docs, n_terms or 0, weights)


class Shard:
    """Forward index and impact-sorted lists of some documents."""

    def __init__(self, batch: pa.RecordBatch, stats: Statistics):
        ids = batch["doc_id"]
        self.ids = ids.fill_null(_NO_ID).to_numpy()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        terms, counts = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
        lengths = np.diff(batch["terms"].offsets.to_numpy())
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        length = 100 - LENGTH_SHARE + LENGTH_SHARE * batch["n"].to_numpy() * stats.n_docs // stats.n_terms
        self.term, self.impact = terms, SCALE * counts // (1000 * counts + SATURATION * np.repeat(length, lengths))
        # a list after another, each by falling impact, which is 1,000,000 at most
        order = np.argsort(terms * (1 << 20) + (1_000_000 - self.impact), kind="stable")
        self.list_first = np.searchsorted(terms[order], np.arange(len(stats.weights) + 1))
        self.list_doc, self.list_impact = np.repeat(np.arange(len(lengths)), lengths)[order], self.impact[order]

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of documents that hold terms, by their rows of the forward index."""
        sizes = self.first[docs + 1] - self.first[docs]
        starts = np.cumsum(sizes) - sizes
        rows = np.arange(sizes.sum()) + np.repeat(self.first[docs] - starts, sizes)
        return np.add.reduceat(weights[self.term[rows]] * self.impact[rows], starts)

    def search(self, terms: np.ndarray, weights: np.ndarray, all_weights: np.ndarray, best: Best, met: np.ndarray) -> int:
        """The algorithm for one item; best has what earlier shards gave. all_weights: by place, 0 for other terms; met: false for each document, and left so. Returns how many were looked up."""
        low, high = self.list_first[terms], self.list_first[terms + 1]
        held = high > low
        low, high, weights = low[held], high[held], weights[held]
        step, looked = FIRST_ROUND, []
        while len(low):
            if best.full and int(weights @ self.list_impact[low]) < best.least:  # no document from here on scores more
                break
            ends = np.minimum(low + step, high)
            sizes = ends - low
            entries = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
            docs = np.unique(self.list_doc[entries])
            docs = docs[~met[docs]]
            if len(docs):
                met[docs] = True
                looked.append(docs)
                best.add(self.ids[docs], self.known[docs], self.scores(docs, all_weights))
            on = ends < high
            low, high, weights = ends[on], high[on], weights[on]
            step *= 2
        for docs in looked:
            met[docs] = False
        return sum(map(len, looked))


class Best:
    """The k best documents by score, then by id."""

    def __init__(self, k: int):
        self.k, self.ids, self.known, self.score = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.score) == self.k

    @property
    def least(self) -> int:
        return int(self.score[-1])

    def add(self, ids: np.ndarray, known: np.ndarray, score: np.ndarray) -> None:
        able = score >= (self.least if self.full else 1)
        if not able.any():
            return
        ids, known, score = (np.concatenate([a, b[able]]) for a, b in ((self.ids, ids), (self.known, known), (self.score, score)))
        order = np.lexsort((ids, -score))[: self.k]
        self.ids, self.known, self.score = ids[order], known[order], score[order]


def _shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut, to pieces of about `most` postings."""
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(np.diff(batch["terms"].offsets.to_numpy()))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most - size, "right")))
            held.append(batch.slice(start, end - start))
            size += int(sizes[end - 1] - before)
            start = end
            if size >= most or start < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _candidates(forward: DataFrame, queries: Queries, stats: Statistics, kind: T.DataType, k: int, shard_postings: int) -> DataFrame:
    held, id_type = forward.sparkSession.sparkContext.broadcast((queries, stats)), to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, stats = held.value
        best = [Best(k) for _ in queries.ids]
        weights = np.zeros(len(stats.weights), np.int64)
        for batch in _shards(batches, shard_postings):
            shard, met = Shard(batch, stats), np.zeros(batch.num_rows, bool)
            for (terms, counts), found in zip(queries.own, best):
                own = stats.weights[terms] * counts
                terms, own = terms[own > 0], own[own > 0]
                weights[terms] = own
                shard.search(terms, own, weights, found, met)
                weights[terms] = 0
        sizes = [len(b.ids) for b in best]
        item = np.repeat(np.arange(len(best)), sizes)
        ids, known, score = (np.concatenate([getattr(b, c) for b in best] or [[]]) for c in ("ids", "known", "score"))
        doc_id = pa.array(ids.astype(np.int64), mask=~known.astype(bool))
        yield pa.record_batch([pa.array(item.astype(np.int64)), pa.array([queries.ids[i] for i in item], id_type), doc_id, pa.array(score.astype(np.int64))], ["item", "item_id", "doc_id", "score"])
        give_back()

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    return forward.mapInArrow(run, schema)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (doc_id, text) of each row of items (item_id, text).

    Null texts have no terms; items without terms that any document holds give no rows. Equal scores go by doc_id, null
    last; rows that repeat are ranked each. Empty tables give no rows. Other columns are left out. Terms are equal if their
    64-bit hashes are.
    """
    spark = docs.sparkSession
    given = items.select("item_id", "text").where("text is not null")
    blocks = 1 + (given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    kind = items.schema["item_id"].dataType
    found = []
    for block in range(blocks):
        part = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else given
        queries = Queries.of(part.collect())  # about block_bytes
        forward = written(forward_index(docs, queries.terms), "forward-index")
        stats = Statistics.of(forward, len(queries.terms))
        if not stats.n_docs:
            continue
        best = _candidates(forward, queries, stats, kind, k, shard_postings)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))  # of k rows a task
        found.append(best.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return reduce(DataFrame.unionByName, found)
