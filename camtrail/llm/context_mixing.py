"""Language-model scores by online logistic context mixing (operator 2).

A text's events are its words and one end. All words that no training text has are one event, as in the base score. A
word is coded by the bits of its hash, first bit first, down a binary tree over the training words: the first TREE_BITS
by a tree whose leaves are prefixes, the others by a tree below each prefix that is deep enough to tell its words apart. Each bit has a predictor for each context: the tree node alone, and the node in each document class
(k-means over hashed words). Their counts come from all training texts. Predictions are mixed in the logistic domain,
by weights that are gated by how much the class and the corpus have seen of the node and that are refined online, level
by level, on left-one-out counts; the tree above the prefixes has its weights, and so has each below. That yields each word's probability for each class.
All of it follows from the training texts alone: neither their order, nor other texts, nor how work is cut, changes it.

Within a document the mixture adapts: each class's model stands with and without a cache of the document's own words
so far, and their weights follow from how well each has predicted it. To that come hashed contexts of previous words: of
ORDERS words in all training texts but the one that is scored, and of one and two words in the text itself so far. They are mixed by word,
not by bit, as counts for every node in every context would multiply what is shuffled: weights start from how often the
context was seen, by a fixed rule, and follow the gradient along the text, STEP_WORDS words at a time.
total bits = -score / log10(2).

Texts are dealt with in blocks. A block sends its words and contexts, with their counts in its training texts, to the
slices of the hash space that they belong to, many more slices than machines. A slice adds them up over all blocks, and
answers each part of a block for what it has sent, in that order. A slice holds whole trees of prefixes, of which there
are 2 ** TREE_BITS at every size, so their sums, which are broadcast, never grow.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camtrail.llm.storage import free_since, written, written_so_far
from camtrail.llm.tables import give_back, numbered, small_batches
from camtrail.llm.text_arrays import NOT_SPACE, Words, mixed, words_of

CLASSES = 4
#: Features and rounds of the fit of the document classes, and the unit in which vectors are kept and summed.
CLASS_FEATURES = 1 << 12
CLASS_ROUNDS = 12
UNIT = 2.0**-15
VECTOR_BYTES = 256 << 10
#: Far texts are drawn as starts much sooner than near ones, which rarely start a class of their own, but odd ones not always.
START_POWER = 8
#: Bits of the prefixes, and bytes of text for each slice of the hash space, which holds one prefix at least.
TREE_BITS = 14
SLICE_BYTES = 2 << 20
BLOCK_ROWS = 2048
#: Tokens that are scored at once, about.
GROUP_TOKENS = 1 << 16
#: Longer texts are blocks of their own.
BLOCK_TEXT = 1 << 16
PASSES = 1
PRIOR = 0.4
CACHE = 0.2
BASE_PRIOR = 0.1
END = np.uint64(0xE4D0F7E47E57A11E)
#: Contexts of so many words before, in the corpus.
ORDERS = 1
#: Of the mixture with the contexts: words between updates of the weights, their rate, and counts at which a context has half its share.
STEP_WORDS = 16
RATE = 0.05
HALF_SEEN = (*(8.0, 2.0)[:ORDERS], 4.0, 1.0)
_STEP = 1.0 / 1000  # of a natural logarithm, in the packed scores: up to 65.5
WORDS, STATS = 0, -1
_ASKED_SCHEMA = "kind int, slice long, block long, first long, last long, hashes binary, known binary, n binary"
_ANSWER_SCHEMA = "kind int, slice long, block long, first long, last long, counts binary, logs binary, stats array<long>"


def _held_features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words of a text as a unit vector: the features that it holds, and their values."""
    counts = np.bincount((words % np.uint64(CLASS_FEATURES)).astype(np.int64))
    held = np.flatnonzero(counts)
    values = np.log1p(counts[held])
    return held, values / max(np.linalg.norm(values), 1e-12)


def _features(words: np.ndarray) -> np.ndarray:
    """The same with all features."""
    vector = np.zeros(CLASS_FEATURES)
    held, values = _held_features(words)
    vector[held] = values
    return vector


def _feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector of each text that has words, as its features and whole numbers of UNITs, whose sums are the same in any order."""
    for part in small_batches(batches, "text", 1 << 20):
        text, out = words_of(part["text"], NOT_SPACE), []
        for key, a, b in zip(part["key"].to_pylist(), text.first[:-1], text.first[1:]):
            if b > a:
                held, values = _held_features(text.hash[a:b])
                out.append((key, held.astype("<u2").tobytes(), np.rint(values / UNIT).astype("<u2").tobytes()))
        keys, features, values = zip(*out) if out else ((), (), ())
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(features, pa.binary()), pa.array(values, pa.binary())], ["key", "features", "units"])


def _joined_numbers(column: pa.Array) -> np.ndarray:
    """The two-byte numbers of all rows of a binary column without nulls, one after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<u2", (offsets[-1] - offsets[0]) // 2, offsets[0])


def _cosines(batch: pa.RecordBatch, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and units of all texts of a batch, one after the other, and each text's cosine with each centroid (a column each)."""
    sizes = pa.compute.binary_length(batch["features"]).to_numpy() // 2
    features, units = _joined_numbers(batch["features"]).astype(np.int64), _joined_numbers(batch["units"])
    starts, values = np.cumsum(sizes) - sizes, units * UNIT
    cosines = np.empty((len(sizes), centroids.shape[1]))
    for k, centroid in enumerate(np.ascontiguousarray(centroids.T)):
        cosines[:, k] = np.add.reduceat(centroid.take(features) * values, starts)
    return features, units, cosines


def _next_start(centroids: np.ndarray):
    """The text of a batch that an exponential race picks, at rates of a power of its distance from the nearest centroid."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "features", VECTOR_BYTES):
            near = _cosines(batch, centroids)[2].max(1) if centroids.shape[1] else np.zeros(batch.num_rows)
            own = batch["key"].to_numpy().view(np.uint64)
            drawn = (mixed(own + np.uint64(centroids.shape[1])) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            time = -np.log1p(-drawn) / np.maximum(1 - near, 1e-9) ** START_POWER
            first = int(np.lexsort((own, time))[0])
            yield pa.record_batch([pa.array(time[[first]]), *(batch[c].slice(first, 1) for c in ("key", "features", "units"))], ["time", "key", "features", "units"])

    return run


def _class_sums(centroids: np.ndarray):
    """The sums of units, by feature, of the texts nearest to each centroid: a row a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = centroids.shape[1]
        total = np.zeros(k * CLASS_FEATURES, np.int64)
        for batch in small_batches(batches, "features", VECTOR_BYTES):
            features, units, cosines = _cosines(batch, centroids)
            sizes = pa.compute.binary_length(batch["features"]).to_numpy() // 2
            at = np.repeat(cosines.argmax(1), sizes) * CLASS_FEATURES + features
            total += np.bincount(at, units, k * CLASS_FEATURES).astype(np.int64)  # whole numbers far under 2 ** 53
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], ["at", "n"])

    return run


def fit_classes(rows: DataFrame, classes: int = CLASSES) -> np.ndarray:
    """Unit centroids, a column each, by k-means over all training texts (rows: row_id, text, trained), repeated ones as often as they are there.

    Starts are drawn by distance, one after the other, by hashes of the texts; sums are of whole numbers. So neither order nor slices change anything.
    """
    mark, texts = written_so_far(), rows.where("trained").select(F.xxhash64("text").alias("key"), "text")
    vectors = written(texts.mapInArrow(_feature_rows, "key long, features binary, units binary"), "class-vectors")
    centroids = np.zeros((CLASS_FEATURES, 0))
    for _ in range(classes):
        drawn = vectors.mapInArrow(_next_start(centroids), "time double, key long, features binary, units binary").orderBy("time", "key").first()
        if drawn is None:
            free_since(mark)
            return np.zeros((CLASS_FEATURES, 1), np.float32)
        start = np.zeros(CLASS_FEATURES)
        start[np.frombuffer(drawn["features"], "<u2")] = np.frombuffer(drawn["units"], "<u2") * UNIT
        centroids = np.concatenate([centroids, start[:, None]], 1)
    for _ in range(CLASS_ROUNDS):
        sums = np.zeros(classes * CLASS_FEATURES)
        for r in vectors.mapInArrow(_class_sums(centroids), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a class and feature
            sums[r["at"]] = r["n"]
        sums = sums.reshape(classes, CLASS_FEATURES).T
        norms = np.linalg.norm(sums, axis=0)
        moved = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
        if (moved == centroids).all():
            break
        centroids = moved
    free_since(mark)
    return np.ascontiguousarray(centroids.astype(np.float32))


def _stretch(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    p = (part + PRIOR) / (whole + 2 * PRIOR)
    return np.log(p) - np.log1p(-p)


def _inputs(part: np.ndarray, whole: np.ndarray, tree: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gates of nodes' predictors for a class, and what the corpus and the class predict. part, whole: counts of nodes and of their parents, in the corpus, then in each class."""
    level = lambda n, most: np.minimum(most, np.log2(n + 1)).astype(np.int64)
    gate = level(whole[:, k + 1], 11) * 8 + level(whole[:, 0], 21) // 3 + tree * _GATES
    return gate, _stretch(part[:, 0], whole[:, 0]), _stretch(part[:, k + 1], whole[:, k + 1])


_GATES = 12 * 8


def tree_scores(words: np.ndarray, counts: np.ndarray, first_bit: int, depth: int | None = None) -> np.ndarray:
    """Natural logarithm of each word's probability among those with its first_bit first bits, for each class.

    words: sorted hashes; counts by class, none of them all zero. Each prefix has a tree and weights of its own, of the
    given depth, or deep enough to tell its words apart.
    """
    n, classes = counts.shape
    if not n:
        return np.zeros((n, classes))
    tree = words >> np.uint64(64 - first_bit) if first_bit else np.zeros(n, np.uint64)
    edges = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    own = np.diff(np.append(edges, n))
    tree = np.repeat(np.arange(len(edges)), own)
    deep = first_bit + np.where(own > 1, np.floor(np.log2(own)).astype(np.int64) + 7, 0) if depth is None else np.full(len(own), depth)
    deep = np.minimum(deep, 64)
    bottom = deep[tree]
    total = counts.sum(1)
    both = np.concatenate([total[:, None], counts], 1).astype(np.float64)  # the corpus, then the classes
    # of each level its nodes, without those whose parent holds a single word: from there on that word's counts stay the same
    parent, levels = np.repeat(np.add.reduceat(both, edges, axis=0), own, axis=0), []
    crowd, alone = own[tree], np.full(n, first_bit)
    for bit in range(first_bit, int(deep.max())):
        rows = np.flatnonzero((bottom > bit) & (crowd > 1))
        prefix = words[rows] >> np.uint64(63 - bit)
        starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(rows) else rows
        size = np.diff(np.append(starts, len(rows)))
        child = np.add.reduceat(both[rows], starts, axis=0)
        levels.append((rows, np.repeat(np.arange(len(size)), size), parent[rows[starts]], child))
        parent[rows], crowd[rows], alone[rows] = np.repeat(child, size, axis=0), np.repeat(size, size), bit + 1
    gates = len(edges) * _GATES
    weights = np.tile([0.3, 0.7], (classes, gates, 1))
    for k in range(classes):
        held = np.flatnonzero(counts[:, k] > 0)
        at, c = np.cumsum(counts[:, k] > 0) - 1, counts[held, k]
        # what is known without the word itself
        lone = _inputs(both[held] - 1, both[held] - 1, tree[held], k)
        for bit, (rows, node, above, child) in [*enumerate(levels, first_bit)] * PASSES:
            some = np.flatnonzero(child[:, k + 1] > 0)
            inputs = _inputs(child[some] - 1, above[some] - 1, tree[rows[np.searchsorted(node, some)]], k)
            inside = np.flatnonzero(counts[rows, k] > 0)
            place, known = at[rows[inside]], np.searchsorted(some, node[inside])
            gate, *s = (x.copy() for x in lone)
            for x, new in zip((gate, *s), inputs):
                x[place] = new[known]
            use = np.flatnonzero(bottom[held] > bit)
            gate, n_use, s = gate[use], c[use], [x[use] for x in s]
            w = weights[k][gate]
            p = 1 / (1 + np.exp(-(w[:, 0] * s[0] + w[:, 1] * s[1])))
            pulls, curves = n_use * (1 - p), n_use * p * (1 - p)
            for i in (0, 1):
                pull, curve = np.bincount(gate, pulls * s[i], gates), np.bincount(gate, curves * s[i] ** 2, gates) + 5.0
                weights[k][:, i] += 0.3 * np.clip(pull / curve, -1, 1)
    out, lost = np.zeros((n, classes)), np.empty((n, classes))
    for k in range(classes):
        for rows, node, above, child in levels:
            gate, corpus, own_class = _inputs(child, above, tree[rows[np.searchsorted(node, np.arange(len(child)))]], k)
            w = weights[k][gate]
            out[rows, k] -= np.logaddexp(0, -(w[:, 0] * corpus + w[:, 1] * own_class))[node]
        gate, corpus, own_class = _inputs(both, both, tree, k)
        w = weights[k][gate]
        lost[:, k] = np.logaddexp(0, -(w[:, 0] * corpus + w[:, 1] * own_class))
    for level in range(int((bottom - alone).max())):
        rows = np.flatnonzero(bottom - alone > level)
        out[rows] -= lost[rows]
    # words that share all bits share their leaf by their counts
    leaf = np.where(bottom > 0, words >> (np.uint64(64) - np.maximum(bottom, 1).astype(np.uint64)), np.uint64(0))
    leaf = np.cumsum(np.concatenate([[False], (leaf[1:] != leaf[:-1]) | (tree[1:] != tree[:-1])]))
    return out + np.log(total / np.bincount(leaf, total)[leaf])[:, None]


def _with_ends(text: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, each text with its end, and how many each has."""
    return np.insert(text.hash, text.first[1:], END), np.diff(text.first) + 1


def _context_hashes(tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Even hashes of each token with the one before, and with the two before, and so on. An end stands before each text.

    Where a text has fewer tokens before, the hash of the longer context is zero.
    """
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found, last = [], tokens
    for order in range(1, ORDERS + 1):
        last = mixed(np.roll(last, 1) * np.uint64(0xD6E8FEB86659FD93 + 2 * order) + tokens)
        if order == 1:
            last[at == 0] = mixed(tokens[at == 0] + END)
        found.append(np.where(at >= order - 1, last & ~np.uint64(1), np.uint64(0)))
    return found


def _packed(values: np.ndarray) -> bytes:
    """Sorted values as differences, by planes of bytes, which compress."""
    return np.diff(values, prepend=np.zeros(1, values.dtype)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes where they are small, else as they are."""
    return (counts.astype(np.uint8) if counts.max() < 256 else counts).tobytes()


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    blocks = batch["block"].to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(blocks[a]), batch.slice(a, b - a)


def _by_slice(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The slices that sorted keys belong to."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(keys) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(part[a]), slice(a, b)


def _asked(held, bits: int):
    """Each block's different words, with how often its training texts of each class have them; and its different words
    in context, with how often training texts and all texts have them. In parts, by slice of the hash space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = held.value.astype(np.float64)
        for batch in small_batches(batches, "text"):
            for block, part in _blocks(batch):
                text, out = words_of(part["text"], NOT_SPACE), []
                trained = part["trained"].to_numpy(zero_copy_only=False)
                own = np.array([int((_features(text.hash[a:b]) @ classes).argmax()) if t else CLASSES for t, a, b in zip(trained, text.first[:-1], text.first[1:])])
                tokens, sizes = _with_ends(text)
                seen, place = np.unique(tokens, return_inverse=True)
                counts = np.bincount(np.repeat(own, sizes) * len(seen) + place, minlength=(CLASSES + 1) * len(seen)).reshape(CLASSES + 1, -1)[:CLASSES].astype(np.int32)
                out += [(WORDS, s, _packed(seen[x]), _small(counts[:, x]), None) for s, x in _by_slice(seen, bits)]
                flags = np.repeat(trained, sizes).astype(np.uint64)
                for order, hashes in enumerate(_context_hashes(tokens, sizes), 1):
                    keys = np.sort((hashes | flags)[hashes > 0])  # the lowest bit tells training texts
                    starts = np.flatnonzero(np.concatenate([[True], keys[1:] >> np.uint64(1) != keys[:-1] >> np.uint64(1)])) if len(keys) else np.zeros(0, np.int64)
                    seen, n = keys[starts] & ~np.uint64(1), np.diff(np.append(starts, len(keys))).astype(np.int32)
                    known = np.add.reduceat((keys & np.uint64(1)).astype(np.int32), starts, dtype=np.int32) if len(keys) else n
                    out += [(order, s, _packed(seen[x]), _small(known[x]), _small(n[x])) for s, x in _by_slice(seen, bits)]
                kind, where, hashes, known, n = zip(*out)
                rows = (block, part["row_id"][0].as_py(), part["row_id"][-1].as_py())
                yield pa.record_batch(
                    [pa.array(kind, pa.int32()), pa.array(where), *(pa.array(np.full(len(out), x)) for x in rows), pa.array(hashes), pa.array(known), pa.array(n, pa.binary())],
                    ["kind", "slice", "block", "first", "last", "hashes", "known", "n"],
                )

    return run


def _numbers(data: bytes, n: int) -> np.ndarray:
    """What _small() has made of n numbers."""
    return np.frombuffer(data, np.uint8 if len(data) == n else np.int32)


def _summed(parts: list[np.ndarray], order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.concatenate(parts).astype(np.int64)[order], starts)


def _answered(bits: int):
    """What a slice knows of the words or contexts that parts of blocks have sent it: counts, zero where they are of no use, and logs of the others."""

    def run(table: pa.Table) -> pa.Table:
        kind, where = table["kind"][0].as_py(), table["slice"][0].as_py()
        hashes = [_unpacked(h) for h in table["hashes"].to_pylist()]
        every = np.concatenate(hashes)
        order = np.argsort(every)
        new = np.diff(every[order], prepend=every[order[:1]] ^ np.uint64(1)) != 0
        starts, place = np.flatnonzero(new), np.empty(len(every), np.int64)
        place[order] = np.cumsum(new) - 1
        known = table["known"].to_pylist()
        out, logs = [], None
        if kind == WORDS:
            counts = np.stack([_summed([_numbers(k, CLASSES * len(h))[c * len(h) : (c + 1) * len(h)] for k, h in zip(known, hashes)], order, starts) for c in range(CLASSES)], 1)
            n, words = counts.sum(1), every[order][starts]
            keep, logs = n > 0, np.zeros(len(n), np.uint64)
            if keep.any():
                found = tree_scores(words[keep], counts[keep], TREE_BITS)
                # rounded down, so that probabilities sum to one at most
                packed = np.clip(np.ceil(-found / _STEP), 0, 65535).astype(np.uint64)
                logs[keep] = sum(packed[:, c] << np.uint64(16 * c) for c in range(CLASSES))
            below = (words[keep] >> np.uint64(64 - TREE_BITS)).astype(np.int64)
            prefixes, edges = np.unique(below, return_index=True)  # words are sorted, so those of a prefix lie together
            sums = np.concatenate([prefixes[:, None], np.add.reduceat(counts[keep], edges, axis=0)], 1) if len(edges) else prefixes
            out.append((STATS, where, -1, -1, -1, None, None, [int(keep.sum()), int((n == 1).sum()), *sums.ravel().tolist()]))
        else:
            n = _summed([_numbers(k, len(h)) for k, h in zip(known, hashes)], order, starts)
            n[_summed([_numbers(k, len(h)) for k, h in zip(table["n"].to_pylist(), hashes)], order, starts) < 2] = 0
        n, at = n.astype(np.int32), 0
        for block, first, last, own in zip(*(table[c].to_pylist() for c in ("block", "first", "last")), hashes):
            mine = place[at : at + len(own)]
            at += len(own)
            if n[mine].any():
                planes = None if logs is None else logs[mine[n[mine] > 0]].view(np.uint8).reshape(-1, 8).T.tobytes()
                out.append((kind, where, block, first, last, _small(n[mine]), planes, None))
        give_back()
        types = (pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary(), pa.list_(pa.int64()))
        columns = list(zip(*out)) or [()] * len(types)
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("kind", "slice", "block", "first", "last", "counts", "logs", "stats"), columns, types)})

    return run


def _times(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How often each key is there, of keys that order sorts; new: where the next one starts in that order."""
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(order)))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(size, size)
    return out


def _stable_order(key: np.ndarray) -> np.ndarray:
    """What sorts keys, none under 0, equal ones by their place. With their place in them, where that fits, no two are equal and any sort does, the fastest too."""
    if len(key) and int(key.max()) < (1 << 62) // len(key):
        return np.sort(key * len(key) + np.arange(len(key))) % len(key)
    return np.argsort(key, kind="stable")


def _before(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key, none under 0, how often it has come before; a stable order; and where the next one starts in that order."""
    order = _stable_order(key)
    new = np.diff(key[order], prepend=-1) != 0
    before, at = np.empty(len(key), np.int64), np.arange(len(key))
    before[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return before, order, new


def mixed_logs(plain: np.ndarray, seen: np.ndarray, chance: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural logarithm of each text's probability.

    plain: each token's logarithm without contexts. seen, chance (a column a context): how often its context was seen,
    and the token's share of that. Weights of unseen contexts are zero, so a token's probabilities sum to one at most.
    """
    by = np.argsort(-sizes, kind="stable")
    # runs of STEP_WORDS tokens of a text, by their place in it, the longest texts first: a step's runs lie together, and all steps start with the same texts
    lows = np.arange(0, int(sizes.max(initial=0)), STEP_WORDS)
    active = np.searchsorted(-sizes[by], -lows, "left")  # the texts with more than low tokens
    ends = np.cumsum(active)
    rank, low = np.arange(active.sum()) - np.repeat(ends - active, active), np.repeat(lows, active)
    n = np.minimum(sizes[by][rank] - low, STEP_WORDS)
    edge = np.cumsum(n) - n
    token = np.repeat(first[by][rank] + low - edge, n) + np.arange(n.sum())
    start = np.ones((len(token), 1 + chance.shape[1]))
    start[:, 1:] = seen[token]
    start[:, 1:] /= start[:, 1:] + HALF_SEEN
    p = np.empty_like(start)
    p[:, 0], p[:, 1:] = np.exp(plain[token]), chance[token]
    moved, likely = np.zeros((len(sizes), p.shape[1])), np.empty((len(token), 1))
    for a, b in zip(ends - active, ends):
        x, texts = slice(edge[a], edge[b - 1] + n[b - 1]), slice(0, b - a)
        weight = start[x] * np.repeat(np.exp(moved[texts]), n[a:b], axis=0)
        weight /= weight.sum(1, keepdims=True)
        joint = weight * p[x]
        whole = np.maximum(joint.sum(1, keepdims=True), 1e-300, out=likely[x])
        joint /= whole
        joint -= weight
        moved[texts] = np.clip(moved[texts] + RATE * np.add.reduceat(joint, edge[a:b] - edge[a], axis=0), -8, 8)
    total = np.zeros(len(sizes))
    np.add.at(total, by[rank], np.add.reduceat(np.log(likely[:, 0]), edge))
    return total


@dataclass
class Known:
    """What the slices have answered to a part of a block.

    place: each token's index in counts and logs (a column a class), the last for all unknown ones; contexts: each
    token's count in its context of one word, and so on.
    """

    place: np.ndarray
    counts: np.ndarray
    logs: np.ndarray
    contexts: list[np.ndarray]


def known_to(tokens: np.ndarray, sizes: np.ndarray, answers: list[dict], bits: int, shares: np.ndarray, unknown: float) -> Known:
    """The answers (rows of one part) laid beside the part's tokens. shares: of each prefix by class; unknown: of all unknown words."""

    def counted(kind: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, counts, logs = {a["slice"]: a for a in answers if a["kind"] == kind}, np.zeros(len(seen), np.int64), np.zeros(len(seen), np.uint64)
        for s, x in _by_slice(seen, bits):
            if s in own:
                counts[x] = _numbers(own[s]["counts"], x.stop - x.start)
                if kind == WORDS:
                    logs[x.start + np.flatnonzero(counts[x])] = np.frombuffer(own[s]["logs"], np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
        return counts, logs

    seen, place = np.unique(tokens, return_inverse=True)
    counts, packed = counted(WORDS, seen)
    logs = np.stack([-((packed >> np.uint64(16 * c)) & np.uint64(0xFFFF)).astype(np.float64) * _STEP for c in range(CLASSES)], 1)
    logs += shares[(seen >> np.uint64(64 - TREE_BITS)).astype(np.int64)]
    contexts = []
    for order, hashes in enumerate(_context_hashes(tokens, sizes), 1):
        keys, at = np.unique(hashes, return_inverse=True)
        real = keys > 0  # zero stands for contexts that are not there
        contexts.append(np.concatenate([np.zeros(int(not real.all()), np.int64), counted(order, keys[real])[0]])[at])
    place = np.where(counts[place] > 0, place, len(seen))
    return Known(place, np.append(counts, 0), np.concatenate([logs, np.full((1, CLASSES), unknown)]), contexts)


def _class_mixture(plain: np.ndarray, cache: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural logarithm of each token by the classes' models (plain: a row a class) with and without the cache, whose weights are their likelihoods so far."""
    k = len(plain)
    experts = np.empty((2 * k, len(cache)))  # a row an expert: numpy adds and compares along rows, not across them
    experts[:k] = plain
    experts[k:] = np.log((1 - CACHE) * np.exp(experts[:k]) + CACHE * cache)
    experts[k:, first] = experts[:k, first]
    experts = np.cumsum(experts, 1, out=experts)
    experts -= np.repeat(np.where(first > 0, experts[:, first - 1], 0.0), sizes, axis=1)
    best = experts.max(0)
    likely = np.exp(np.subtract(experts, best, out=experts), out=experts)
    while len(likely) > 1:  # the mean of the experts' likelihoods, token by token, summed in pairs
        likely = likely[::2] + likely[1::2]
    so_far = best + np.log(likely[0] / (2 * k))
    alone = np.diff(so_far, prepend=0.0)
    alone[first] = so_far[first]
    return alone


def _scored(tokens: np.ndarray, sizes: np.ndarray, is_trained: np.ndarray, answers: Known, base: np.ndarray) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of some texts, given by their tokens."""
    place = answers.place
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(tokens)) - first[doc]
    kinds = np.int64(len(answers.counts))
    before, by, new = _before(doc * kinds + place)
    times = _times(by, new)
    alone = _class_mixture(answers.logs[place].T, before / np.maximum(at, 1), first, sizes)
    # contexts in all training texts but this one
    trained = is_trained[doc]
    counts, hits = answers.counts[place] - np.where(trained, times, 0), []
    for order, hashes in enumerate(_context_hashes(tokens, sizes), 1):
        n = answers.contexts[order - 1].copy()
        own = np.flatnonzero(trained & (n > 0))
        key = mixed(hashes[own] + doc[own].astype(np.uint64))
        by = np.argsort(key)
        n[own] -= _times(by, np.diff(key[by], prepend=key[by[:1]] ^ np.uint64(1)) != 0)
        hits.append(n)
    previous = lambda x, start: np.where(at == 0, start, np.roll(x, 1))
    seen = [previous(counts, counts[first + sizes - 1][doc]), *(previous(n, 0) for n in hits[:-1])]  # an end stands before the first word
    # and in this text so far
    pair, by, new = _before((doc * kinds + previous(place, kinds - 1)) * kinds + place)
    group = np.empty(len(tokens), np.int64)  # a number for those alike
    group[by] = np.cumsum(new) - 1
    triple, _, _ = _before(previous(group, -1) * kinds + place + kinds)
    hits += [np.where(at > 0, pair, 0), np.where(at > 1, triple, 0)]
    seen += [previous(before, 0), np.where(at > 1, previous(pair, 0), 0)]
    seen = np.stack(seen, 1)
    score = mixed_logs(alone, seen, np.stack(hits, 1) / np.maximum(seen, 1), first, sizes) / np.log(10)
    known = np.add.reduceat((place < kinds - 1).astype(np.int64), first)
    return {"n_tokens": sizes, "n_known": known, "base_score": np.add.reduceat(base[place], first), "score": score}


def _groups(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbouring texts of about so many tokens together."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    yield slice(start, len(sizes))


_SCORE_SCHEMA = "row_id long, n_tokens long, n_known long, base_score double, score double"


def _score_block(held, bits: int, all_tokens: int, all_words: int, unknown: float):
    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("row_id", "n_tokens", "n_known", "base_score", "score")}
        docs = docs.sort_by("row_id")
        rows, by_part = docs["row_id"].to_numpy(), defaultdict(list)
        for answer in table.to_pylist():
            by_part[answer["first"], answer["last"]].append(answer)
        # parts follow each other; texts that no answer names hold unknown words alone
        starts = sorted({0, len(rows), *(int(x) for part in by_part for x in (np.searchsorted(rows, part[0]), np.searchsorted(rows, part[1], "right")))})
        for a, b in zip(starts[:-1], starts[1:]):
            part = docs.slice(a, b - a)
            tokens, sizes = _with_ends(words_of(part["text"], NOT_SPACE))
            answers = known_to(tokens, sizes, by_part.get((int(rows[a]), int(rows[b - 1])), []), bits, held.value, unknown)
            base = np.log10((answers.counts + BASE_PRIOR) / (all_tokens + BASE_PRIOR * (all_words + 1)))
            trained, edges = part["trained"].to_numpy(), np.append(0, np.cumsum(sizes))
            for group in _groups(sizes, GROUP_TOKENS):
                x = slice(edges[group.start], edges[group.stop])
                own = Known(answers.place[x], answers.counts, answers.logs, [c[x] for c in answers.contexts])
                for name, values in _scored(tokens[x], sizes[group], trained[group], own, base).items():
                    out[name].append(values)
            out["row_id"].append(rows[a:b])
        give_back()
        kinds = (np.int64, np.int64, np.int64, np.float64, np.float64)
        return pa.table({c: np.concatenate([np.zeros(0, t), *x]).astype(t) for (c, x), t in zip(out.items(), kinds)})

    return run


def text_scores(docs: DataFrame, trained: Column) -> DataFrame:
    """Scores of every row of docs (doc_id, text), learned from those for which trained (a condition on doc_id) holds.

    row_id, doc_id, n_tokens, n_known, train_tokens, base_score (add-0.1 unigram), score (log10 of the model's
    probability), bits and bits_per_byte. A text that isn't trained on changes no other's scores. A null text counts as
    empty and has its end alone. Repeated rows get equal scores, but for the contexts that a training text leaves out
    of its own counts; an empty table gives none; without training texts every word is unknown, with probability 1.
    Further columns are ignored. docs is read from files.
    """
    spark = docs.sparkSession
    rows = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), trained.alias("trained")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(TREE_BITS, max(4, (size // SLICE_BYTES).bit_length()))
    # a block: neighbouring rows, or a single long text
    block = F.when(F.octet_length("text") > BLOCK_TEXT, -1 - F.col("row_id")).otherwise(F.floor(F.col("row_id") / BLOCK_ROWS))
    blocks = rows.select("row_id", "text", F.coalesce("trained", F.lit(False)).alias("trained"), block.alias("block"))
    classes = spark.sparkContext.broadcast(fit_classes(rows))
    asked = blocks.select("block", "row_id", "text", "trained").mapInArrow(_asked(classes, bits), _ASKED_SCHEMA)
    answers = written(asked.groupBy("kind", "slice").applyInArrow(_answered(bits), _ANSWER_SCHEMA), "answers", free=True)

    sums, known, once = np.zeros((1 << TREE_BITS, CLASSES), np.int64), 0, 0
    for r in answers.where(F.col("kind") == STATS).select("stats").toLocalIterator():  # numbers of 2 ** TREE_BITS prefixes
        own = np.array(r["stats"][2:], np.int64).reshape(-1, 1 + CLASSES)
        sums[own[:, 0]], known, once = own[:, 1:], known + r["stats"][0], once + r["stats"][1]
    all_tokens = int(sums.sum())
    # as much for unknown words as training tokens are the only ones of their kind
    unknown = min(1.0, (once + 0.5) / (all_tokens + 0.5)) if not all_tokens else min(0.5, (once + 0.5) / (all_tokens + 1))
    some = np.flatnonzero(sums.any(1))
    shares = np.zeros(sums.shape)  # of prefixes without words nothing is asked
    shares[some] = tree_scores(some.astype(np.uint64) << np.uint64(64 - TREE_BITS), sums[some], 0, TREE_BITS) + np.log(max(1e-12, 1 - unknown))
    held = spark.sparkContext.broadcast(shares)
    found = blocks.groupBy("block").cogroup(answers.where(F.col("kind") >= WORDS).groupBy("block")).applyInArrow(_score_block(held, bits, all_tokens, known, float(np.log(unknown))), _SCORE_SCHEMA)
    found = written(found, "scores", free=True)
    lost = -F.col("score") / float(np.log10(2))
    return rows.select("row_id", "doc_id", F.octet_length("text").alias("n_bytes")).join(found, "row_id").select(
        "row_id", "doc_id", "n_tokens", "n_known", F.lit(all_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        lost.alias("bits"), (lost / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
