"""Ranked search against the scores of all pairs."""

import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from samples import corpus, words

from camtrail.llm import lexical_search as ls

DOCS = "doc_id long, text string, n long, score string, item_id string"
ITEMS = "item_id long, text string, doc_id long, rank string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(text))


def plain(docs, items, k):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t, *_ in docs if terms(t)]
    n, total, df = len(held), sum(size for *_, size in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text, *_ in items:
        wanted, scores = Counter(terms(text)), []
        for doc, counts, size in held:
            m, score = 100 - 25 + (25 * size * n) // total, 0
            for t, times in wanted.items():
                if tf := counts.get(t):
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


def made(seed):
    rng = random.Random(seed)
    docs = [(d, t, 1, "x", "y") for d, t in corpus(seed)] + [(None, words(rng, 30), 1, "", ""), (None, "w1 w2", 1, "", ""), (3, "w1 w2", 1, "", ""), (3, "w1 w2", 1, "", "")]
    docs += [(2000 + i, "tie tie w5", 1, "", "") for i in range(30)] + [(5000, "W1 w1\x7fÜ-w1 " * 9, 1, "", "")]
    items = [(i, words(rng, rng.choice([1, 5, 40])), 1, "") for i in range(12)] + [(50, "tie", 0, ""), (50, "tie", 0, ""), (51, None, 0, ""), (52, "", 0, ""), (53, "nowhere", 0, ""), (None, "w1 w1 Ü", 0, ""), (54, words(rng, 900), 0, "")]
    return docs, items


@pytest.mark.parametrize("seed, k, block, shard", [(1, 20, 1 << 20, 1 << 20), (2, 3, 1 << 20, 50), (3, 20, 300, 1), (4, 1, 1 << 20, 400)])
def test_ranked(spark, stored, seed, k, block, shard):
    docs, items = made(seed)
    found = ls.ranked(stored(docs, DOCS), stored(items, ITEMS, 1, "items"), k, block, shard)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, found.collect()))) == plain(docs, items, k)


def test_empty_tables(spark, stored):
    docs, items = made(1)
    for some, queries in (([], items), (docs, []), ([(1, None, 1, "", "")], items)):
        found = ls.ranked(stored(some, DOCS, 1), stored(queries, ITEMS, 1, "items"))
        assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_reading_stops_early():
    """A rare term's documents come first; those that hold the common term alone aren't all looked up."""
    rng = np.random.default_rng(5)
    n = 20_000
    rare = np.arange(n) % 400 == 0
    lists = [[0, 1] if r else [0] for r in rare]
    counts = [list(c) for c in (rng.integers(1, 9, len(x)) for x in lists)]
    batch = pa.record_batch([pa.array(np.arange(n)), pa.array(rng.integers(50, 60, n)), pa.array(lists, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])
    stats = ls.Statistics(n, 55 * n, np.array([500, 6000]))
    shard, best, met = ls.Shard(batch, stats), ls.Best(20), np.zeros(n, bool)
    looked = shard.search(np.array([0, 1]), stats.weights, stats.weights, best, met)
    every = shard.scores(np.arange(n), stats.weights)
    order = np.lexsort((np.arange(n), -every))[:20]
    assert best.ids.tolist() == order.tolist() and best.score.tolist() == every[order].tolist()
    assert looked < n // 4 and not met.any()
    assert shard.search(np.array([0, 1]), stats.weights, stats.weights, best, met) <= looked
