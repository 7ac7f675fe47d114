"""Exact top-k inner products with a vector-approximation file (operator 7).

The file holds each vector's integer components and, in a column of its own, its cells: one byte a dimension, in equal
steps between the dimension's least and largest value. A scan of the cells gives a score from the cells' lower edges,
and with it bounds: the true score exceeds it by the sum of steps that the query's positive components can add, and
falls short by those of the negative ones. Vectors whose upper bound is under the kth lower bound are out. Of the
others, the k with the best bounds are read exactly first; then those whose upper bound still reaches the kth exact
score, which settles the result.

Queries come in blocks of bounded size, each against all rows. Of equal vectors only the k + 1 with the smallest ids
can appear in a result, so the scan meets no more of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from camtrail.llm.storage import written
from camtrail.llm.tables import numbered

SCALE = 1024
STEPS = 256
QUERY_BLOCK = 8192
#: So many pairs of a query and a row to be read exactly are broadcast to where the vectors are; with more, vectors are shuffled.
BROADCAST_PAIRS = 1 << 20
#: A task drops candidates that its best scores rule out by now whenever so many more are held.
HELD_CANDIDATES = 1 << 20
_TILE = 1 << 21
_FILE_SCHEMA = "row_id long, vec_id long, cells binary, vector binary"
_CANDIDATE_SCHEMA = "query int, row_id long, edge double"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row_id, vec_id and vector: components as floor(scale * x); vectors that are null or hold nulls or no numbers are left out."""
    rows = numbered(vectors.select("vec_id", "embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    good = F.col("embedding").isNotNull() & F.forall("embedding", finite) & (F.size("embedding") > 0)
    return rows.where(good).select("row_id", "vec_id", F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("vector"))


def _matrix(lists: pa.ListArray, dimensions: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _ranges(dimensions: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch["vector"], dimensions)
                yield pa.record_batch([pa.array(np.arange(dimensions)), pa.array(m.min(0)), pa.array(m.max(0))], ["d", "low", "high"])

    return run


def _approximated(dimensions: int, low: np.ndarray, step: np.ndarray, most: int):
    """The file's rows; of equal vectors in a batch, the `most` of the smallest ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by([("vec_id", "ascending"), ("row_id", "ascending")])
            m = _matrix(batch["vector"], dimensions)
            cells, held = ((m - low) // step).astype(np.uint8), {}
            keep, exact = [], [row.tobytes() for row in m.astype("<i8")]
            for i, key in enumerate(exact):
                held[key] = held.get(key, 0) + 1
                if held[key] <= most:
                    keep.append(i)
            chosen = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([chosen["row_id"], chosen["vec_id"], pa.array([cells[i].tobytes() for i in keep]), pa.array([exact[i] for i in keep])], ["row_id", "vec_id", "cells", "vector"])

    return run


def _scan(held, low: np.ndarray, step: np.ndarray, k: int):
    """Candidates of every query among a partition's vectors, by their cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, queries = held.value
        slack = (np.abs(queries) * (step - 1)).sum(1)
        best = np.full((len(queries), k), -np.inf)
        out, held_now, most = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0, HELD_CANDIDATES

        def pruned() -> tuple[np.ndarray, ...]:
            q, v, edges = (np.concatenate(x) for x in zip(*out))
            keep = edges >= best.min(1)[q] - slack[q]
            return q[keep], v[keep], edges[keep]

        for batch in batches:
            ids = batch["row_id"].to_numpy()
            cells = np.frombuffer(b"".join(batch["cells"].to_pylist()), np.uint8).reshape(len(ids), len(low))
            tile = max(1, _TILE // len(queries))
            for i in range(0, len(ids), tile):
                edges = queries @ (cells[i : i + tile] * step + low).astype(np.float64).T
                edges[rows[:, None] == ids[None, i : i + tile]] = -np.inf
                best = -np.partition(-np.concatenate([best, edges], 1), k - 1, 1)[:, :k]
                q, v = np.nonzero((edges >= best.min(1, keepdims=True) - slack[:, None]) & np.isfinite(edges))
                out.append((q, ids[i + v], edges[q, v]))
                held_now += len(q)
                if held_now > most:
                    out = [pruned()]
                    held_now, most = len(out[0][0]), len(out[0][0]) + HELD_CANDIDATES
        q, v, edges = pruned()
        yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(v), pa.array(edges)], ["query", "row_id", "edge"])

    return run


def _exact(held):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.value[1].astype(np.int64)
        for batch in batches:
            if batch.num_rows:
                m = np.frombuffer(b"".join(batch["vector"].to_pylist()), "<i8").reshape(batch.num_rows, -1)
                scores = (m * queries[batch["query"].to_numpy()]).sum(1)
                yield pa.record_batch([batch["query"], batch["vec_id"], batch["row_id"], pa.array(scores)], ["query", "vec_id", "row_id", "score"])

    return run


def _block(file: DataFrame, chosen: list, low: np.ndarray, step: np.ndarray, k: int) -> DataFrame:
    spark = file.sparkSession
    rows = np.array([r["row_id"] for r in chosen])
    queries = np.array([r["vector"] for r in chosen], np.float64)
    held = spark.sparkContext.broadcast((rows, queries))
    slack = (np.abs(queries) * (step - 1)).sum(1).tolist()
    about = F.broadcast(spark.createDataFrame([(i, r["vec_id"], s) for i, (r, s) in enumerate(zip(chosen, slack))], "query int, query_id long, slack double"))
    by_edge = Window.partitionBy("query").orderBy(F.desc("edge"), "row_id")
    candidates = written(
        file.select("row_id", "cells").mapInArrow(_scan(held, low, step, k), _CANDIDATE_SCHEMA).withColumn("place", F.row_number().over(by_edge)), "candidates"
    )
    vectors = file.select("row_id", "vec_id", "vector")

    def scored(wanted: DataFrame) -> DataFrame:
        pairs = written(wanted.select("query", "row_id"), "pairs")
        few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
        return vectors.join(F.broadcast(pairs) if few else pairs, "row_id").mapInArrow(_exact(held), "query int, vec_id long, row_id long, score long")

    first = written(scored(candidates.where(F.col("place") <= k)), "scores")
    reached = first.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    positive = spark.createDataFrame([(i, float((np.maximum(q, 0) * (step - 1)).sum())) for i, q in enumerate(queries)], "query int, above double")
    open_ = candidates.where(F.col("place") > k).join(F.broadcast(positive), "query").join(reached, "query").where(F.col("edge") + F.col("above") >= F.col("least"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(scored(open_)).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.join(about, "query").select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k largest integer inner products of each query row with all other rows.

    vectors: vec_id and embedding, read from files; is_query: a condition on vec_id. Ties go to the smaller vec_id, null
    first. Vectors that are null or hold null or non-finite components take no part; vectors are compared with
    those of their own length. Rows that repeat a vec_id are rows of their own. A query without others gives none.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, scale)
    results = []
    for (dimensions,) in rows.select(F.size("vector")).distinct().collect():  # the lengths that occur
        same = rows.where(F.size("vector") == dimensions)
        spans = same.select("vector").mapInArrow(_ranges(dimensions), "d long, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
        low = np.array([r["low"] for r in spans], np.int64)
        step = np.array([(r["high"] - r["low"]) // STEPS + 1 for r in spans], np.int64)
        made = same.mapInArrow(_approximated(dimensions, low, step, k + 1), _FILE_SCHEMA)
        among = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id", "row_id"))
        file = written(made.withColumn("among", among).where(F.col("among") <= k + 1).drop("among"), "approximations")
        queries = written(same.where(is_query), "queries")
        blocks = 1 + queries.count() // block
        for b in range(blocks):
            chosen = queries.where(F.pmod(F.xxhash64("row_id"), F.lit(blocks)) == b).collect()  # about `block` vectors
            if chosen:
                results.append(_block(file, chosen, low, step, k))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, results)
