"""Prefix trie of conversations from the Cartesian tree over their sorted order's LCP array (operator 13).

A conversation is the sequence of its turns' digests. Sorted by it (then by id), conversations that share a prefix are
neighbours, and L[i], the length of the prefix that row i shares with the row before, tells where trie nodes begin and
end: the node of depth d at row i spans the rows up to the next smaller value than d on either side. Rows are dealt to
blocks by range. In each block a stack finds the nearest smaller values on both sides, which gives the intervals of the
Cartesian tree: equal values merge into one node, and the depths between a node and its parent are expanded. Sums over
an interval are differences of running sums:

- leaves: rows whose successor shares less than their whole length;
- saved: the sum of the sizes, from depth d to L[i], of what row i shares with its predecessor, which is the sum over
  the subtree of (members - 1) times the size of the last text.

Intervals that touch a block's first or last row are parts. The minima of blocks, and the LCP of a block's first row
with its predecessor, are one number each a block; the nearest smaller one to the left tells in which block a part's
node begins. Parts of a node are then added up, at most one a block. A task holds the nodes of its block that still
wait for their parent's smallest member, never a whole node's members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from camtrail.llm.storage import written

#: Conversations are rebuilt from the first turns of the one whose id is the next multiple of FAMILY below.
FAMILY, HEADS = 5, 9
#: A block has about so many conversations, or fewer.
BLOCK_ROWS = 100_000
_DIGEST = 16
_BATCH = 20_000
_EMPTY = hashlib.sha256(b"").hexdigest()
#: Kinds of rows that blocks make: nodes, nodes whose parent is a part, parts, and the block itself.
NODE, CHILD, PART, BLOCK = range(4)
_ROW = (
    "kind int, block int, depth long, side int, conv_id long, parent_conv_id long, parent_side int, n_convs long, n_children long, n_leaves long, "
    "saved long, before long, last boolean, ends string, first_key binary, last_key binary, n_first long, n_last long, sizes array<long>"
)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(part.split()[0], _KINDS[part.split()[1]]) for part in _ROW.split(", ")])
_NAMES = _SCHEMA.names


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (turn, mark, size), ordered by turn (null first), equal turns by their digests.

    A null role or text is empty. Rows without conv_id belong to no conversation. A conversation's digests, not its
    texts, make one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", mark.alias("mark"), F.octet_length(text).cast("long").alias("size"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "mark", "size"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, key (digests of its turns, one after another) and sizes of every conversation after rebuilding."""
    own = turns_of(conversations)
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.array().cast(dict(own.dtypes)["turns"])
    both = F.concat(F.slice(F.coalesce("head", none), F.lit(1), n), F.slice("turns", n + 1, F.greatest(F.size("turns") - n, F.lit(0))))
    listed = joined.select("conv_id", both.alias("turns"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), "")).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def shared(a: bytes, b: bytes) -> int:
    """Turns at the beginning that two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // _DIGEST
    if n < 1024:
        at = 0
        while a[at : at + _DIGEST] == b[at : at + _DIGEST]:
            at += _DIGEST
        return at // _DIGEST
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // _DIGEST


@dataclass(slots=True)
class _Open:
    """An LCP value on the stack: its interval so far. left: it begins at the block's first row, or before."""

    depth: int
    least: int
    shared_before: int
    leaves_before: int
    left: bool
    count: int = 0
    children: int = 0
    ends: list = field(default_factory=list)
    kids: list = field(default_factory=list)


class _Block:
    """Nearest smaller values of one block, by a stack; rows of _ROW come out."""

    def __init__(self, block: int):
        self.block, self.stack, self.out = block, [], []
        self.shared = self.leaves = 0
        self.key: bytes | None = None
        self.first: tuple[bytes, list[int]] = (b"", [])
        self.sums: list[int] = [0]

    def add(self, conv: int, key: bytes, sizes: list[int]) -> None:
        n = len(key) // _DIGEST
        if self.key is None:
            self.first, common = (key, sizes), 0
            self.stack.append(_Open(0, conv, 0, 0, True))
        else:
            common = shared(self.key, key)
            self.leaves += common < len(self.key) // _DIGEST
            self._close(common)
            self.shared += self.sums[common]
        if n > common:
            self.stack.append(_Open(n, conv, self.shared, self.leaves, self.key is None))
        top = self.stack[-1]
        top.count, top.least = top.count + 1, min(top.least, conv)
        top.ends.append(conv)
        self.key, self.sums = key, list(accumulate(sizes, initial=0))

    def end(self) -> None:
        self._close(-1)
        row = dict.fromkeys(_NAMES) | {"kind": BLOCK, "block": self.block, "depth": shared(self.first[0], self.key), "first_key": self.first[0], "last_key": self.key}
        self.out.append(row | {"n_first": len(self.first[0]) // _DIGEST, "n_last": len(self.key) // _DIGEST, "sizes": self.first[1]})

    def _close(self, common: int) -> None:
        """Ends the intervals of values over common: there the next smaller value is met, or (-1) the block's end."""
        while self.stack and self.stack[-1].depth > common:
            node = self.stack.pop()
            under = self.stack[-1] if self.stack else None
            low = max(common, under.depth if under else -1)
            if low >= 0 and (under is None or under.depth < low):
                under = _Open(low, node.least, node.shared_before, node.leaves_before, node.left)
                self.stack.append(under)
            (self._parts if node.left or common < 0 else self._nodes)(node, low, under, common < 0)
            if under:
                under.count, under.least = under.count + node.count, min(under.least, node.least)
                under.children += not node.left

    def _row(self, node: _Open, depth: int, kind: int, saved: int, children: int, ends: str | None) -> dict:
        row = dict.fromkeys(_NAMES) | {"kind": kind, "block": self.block, "depth": depth, "conv_id": node.least, "n_convs": node.count}
        return row | {"n_children": children, "n_leaves": self.leaves - node.leaves_before, "saved": saved, "ends": ends}

    def _nodes(self, node: _Open, low: int, under: _Open, _: bool) -> None:
        """All depths from the parent's to the node's, which have the same members."""
        total = self.shared - node.shared_before
        for depth in range(low + 1, node.depth + 1):
            own = depth == node.depth
            ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if own and node.ends else _EMPTY
            row = self._row(node, depth, NODE, total - (node.count - 1) * self.sums[depth - 1], node.children if own else 1, ends)
            if depth == low + 1:
                under.kids.append(row)
            else:
                self.out.append(row | {"parent_conv_id": node.least})
        for kid in node.kids:
            kid["parent_conv_id"] = node.least
        self.out += node.kids

    def _parts(self, node: _Open, low: int, under: _Open | None, last: bool) -> None:
        side = 0 if node.left else 1
        for depth in range(low + 1, node.depth + 1):
            own = depth == node.depth
            children = node.children if own else int(not node.left)
            ends = ",".join(map(str, node.ends)) if own and node.ends else None
            row = self._row(node, depth, PART, self.shared - node.shared_before, children, ends)
            above = side if depth > low + 1 else None if under is None else 0 if under.left else 1
            self.out.append(row | {"side": side, "parent_side": above, "before": self.sums[max(0, depth - 1)], "last": last})
        for kid in node.kids:
            kid["kind"], kid["parent_side"] = CHILD, side
        self.out += node.kids


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = None
    for batch in batches:
        for block, conv, key, sizes in zip(*(batch[c].to_pylist() for c in ("block", "conv_id", "key", "sizes"))):
            if at is None:
                at = _Block(block)
            at.add(conv, key, sizes)
            if len(at.out) >= _BATCH:
                yield pa.RecordBatch.from_pylist(at.out, _SCHEMA)
                at.out = []
    if at is not None:
        at.end()
        for i in range(0, len(at.out), _BATCH):
            yield pa.RecordBatch.from_pylist(at.out[i : i + _BATCH], _SCHEMA)


@dataclass
class Minima:
    """A few numbers of each block, in order: what its first row shares with the row before, the least L within, and ends' figures."""

    blocks: np.ndarray
    values: np.ndarray
    n_first: np.ndarray
    shared_first: np.ndarray
    last_leaf: np.ndarray

    @classmethod
    def of(cls, pieces: DataFrame) -> Minima:
        """Collects some numbers a block; there are as many blocks as partitions, and their keys meet in pairs."""
        shared_udf = F.udf(lambda a, b: -1 if a is None else shared(bytes(a), bytes(b)), "long")
        blocks = pieces.where(F.col("kind") == BLOCK)
        place = Window.orderBy("block")  # of a row a block
        blocks = blocks.withColumn("common", shared_udf(F.lag("last_key").over(place), "first_key"))
        size = F.aggregate(F.slice("sizes", F.lit(1), F.greatest(F.col("common"), F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
        rows = blocks.select("block", "common", "depth", "n_first", "n_last", size.alias("size")).orderBy("block").collect()
        numbers = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 6)
        following = np.append(numbers[1:, 1], -1)
        return cls(numbers[:, 0], numbers[:, 1:3].ravel(), numbers[:, 3], numbers[:, 5], (following < numbers[:, 4]).astype(np.int64))

    def resolved(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts with the block and side at which their node begins, and with what depends on the blocks before and after."""
        for batch in batches:
            block, depth, side = (batch[c].to_numpy() for c in ("block", "depth", "side"))
            at = np.searchsorted(self.blocks, block)
            start = 2 * at + 1  # among values: a block's own minimum; 2 * at: what it shares with the one before
            for d in np.unique(depth[side == 0]):
                smaller = np.flatnonzero(self.values < d)  # the first value is -1
                rows = np.flatnonzero((side == 0) & (depth == d))
                start[rows] = smaller[np.searchsorted(smaller, 2 * at[rows], "right") - 1]
            begins = start >= 2 * at
            common = self.values[2 * at]
            number = lambda name: batch[name].to_numpy()
            last = batch["last"].to_numpy(zero_copy_only=False)
            made = {
                "node_block": self.blocks[start // 2].astype(np.int32), "node_side": (start % 2).astype(np.int32), "begins": begins,
                "n_children": number("n_children") + ((side == 0) & (common <= depth) & (self.n_first[at] > depth)),
                "n_leaves": number("n_leaves") + np.where(last, self.last_leaf[at], 0), "saved": number("saved") + np.where(begins, 0, self.shared_first[at]),
            }
            kept = ("block", "depth", "side", "parent_side", "conv_id", "n_convs", "before", "ends")
            yield pa.record_batch([*(batch[c] for c in kept), *(pa.array(v) for v in made.values())], [*kept, *made])


_RESOLVED = (
    "block int, depth long, side int, parent_side int, conv_id long, n_convs long, before long, ends string, "
    "node_block int, node_side int, begins boolean, n_children long, n_leaves long, saved long"
)


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's lists, one after another; a node's rows are neighbours, and one of them is held at a time."""
    node, digest, out = None, None, []
    for batch in batches:
        for *key, ends in zip(*(batch[c].to_pylist() for c in ("node_block", "depth", "node_side", "ends"))):
            if key == node:
                digest.update(b"," + ends.encode())
                continue
            if node:
                out.append((*node, digest.hexdigest()))
            node, digest = key, hashlib.sha256(ends.encode())
    if node:
        out.append((*node, digest.hexdigest()))
    columns = list(zip(*out)) or [()] * 4
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.string()))], ["node_block", "depth", "node_side", "ends_sha256"])


def prefix_trie(sequences: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each node of the trie of sequences (conv_id, key, sizes): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root has depth 0 and a null parent; equal sequences are ends of one node. Without sequences there are no nodes.
    conv_id doesn't repeat.
    """
    spark = sequences.sparkSession
    sequences = written(sequences, "sequences")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + sequences.count() // block_rows)
    ordered = sequences.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = written(ordered.withColumn("block", F.spark_partition_id()).mapInArrow(_pieces, _ROW), "trie-pieces", free=True)
    minima = Minima.of(pieces)
    node = ["node_block", "depth", "node_side"]
    parts = written(pieces.where(F.col("kind") == PART).mapInArrow(minima.resolved, _RESOLVED), "trie-parts")
    merged = parts.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("before").alias("before"),
        F.max(F.when(F.col("begins"), F.col("parent_side"))).alias("parent_side"),
    )
    listed = parts.where("ends is not null").select(*node, "block", "ends")
    ends = listed.repartition(*node).sortWithinPartitions(*node, "block").mapInArrow(_ends, "node_block int, depth long, node_side int, ends_sha256 string")
    merged = written(merged.join(ends, node, "left").withColumn("saved", F.col("saved") - (F.col("n_convs") - 1) * F.col("before")), "trie-merged")
    # by block, depth and side: the smallest member of the node that a part belongs to
    above = parts.select("block", (F.col("depth") + 1).alias("depth"), F.col("side").alias("parent_side"), *(F.col(c).alias(f"_{c}") for c in node))
    found = merged.select(*(F.col(c).alias(f"_{c}") for c in node), F.col("conv_id").alias("parent_conv_id"))
    above = above.join(found, [f"_{c}" for c in node]).select("block", "depth", "parent_side", "parent_conv_id")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"]
    inner = pieces.where(F.col("kind") == NODE).withColumn("ends_sha256", F.col("ends"))
    under = pieces.where(F.col("kind") == CHILD).drop("parent_conv_id").join(above, ["block", "depth", "parent_side"]).withColumn("ends_sha256", F.col("ends"))
    spanning = merged.withColumn("block", F.col("node_block")).join(above, ["block", "depth", "parent_side"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    return inner.select(*columns).unionByName(under.select(*columns)).unionByName(spanning.select(*columns))


def conversation_trie(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """prefix_trie() of conversations (conv_id, turn, role, text; other columns are left out) after rebuilding.

    saved_tokens counts UTF-8 bytes. Rows without conv_id take no part; equal rows are equal turns; an empty table has
    no nodes.
    """
    return prefix_trie(rebuilt(conversations), block_rows)
