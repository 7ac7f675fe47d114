"""The prefix trie against a plain one, over few and many blocks."""

import random
import zlib
from collections import defaultdict

import brute
import pytest

from camtrail.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, mark string, base string"


def conversations(seed, n=70, alphabet=3):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(300), n):
        start = rng.choice([0, 0, 1, 3])
        rows += [(c, start + t, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "bb", "ünï", None][:alphabet])) for t in range(rng.choice([1, 2, 3, 9, 12]))]
    for c in (1000, 1001, 1002, 1003, 1004, 1005, 1010, 1015, 2001):  # copies; 2001 has no conversation to begin with
        rows += [(c, t, "user", "same" * t) for t in range(10)]
    rows += [(3000, None, "user", "first"), (3000, 0, "user", "then"), (3000, 0, "user", "then"), (3000, 0, "x", "tie"), (3001, 5, None, None), (None, 1, "user", "lost")]
    rows += [(4000, t, "user", "long") for t in range(700)] + [(4005, t, "user", "long") for t in range(650)]
    rng.shuffle(rows)
    return [(*r, "clash", "clash") for r in rows]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            mark = brute.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}")
            own[conv].append((turn is not None, turn or 0, mark, (role or "", text or "")))
    turns = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    sequences = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        sequences[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    saved, leaves = defaultdict(int), defaultdict(int)
    for s in sorted(members, key=len, reverse=True):
        saved[s] += (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0)
        leaves[s] = leaves[s] or 1
        if s:
            saved[s[:-1]] += saved[s]
            leaves[s[:-1]] += leaves[s]
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if sequences[c] == s)
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], brute.sha(ends)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed, block_rows, partitions", [(1, 100_000, 1), (2, 10, 4), (3, 3, 4), (4, 1, 4), (5, 2, 40)])
def test_nodes(spark, stored, seed, block_rows, partitions):
    rows = conversations(seed, alphabet=2 + seed % 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = conversation_trie(stored(rows, SCHEMA, 3, "conversations"), block_rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(repr, map(tuple, found))) == plain(rows)


def test_small_tables(spark, stored):
    assert conversation_trie(stored([], SCHEMA, 1, "none")).count() == 0
    assert conversation_trie(stored([(None, 1, "a", "b", "", "")], SCHEMA, 1, "null")).count() == 0
    # conversation 6 is rebuilt from 5, which is absent; its own turns may all go
    for rows in ([(6, 0, "a", "b", "", "")], [(c, 0, "a", "b", "", "") for c in range(1, 12)]):
        assert sorted(map(repr, map(tuple, conversation_trie(stored(rows, SCHEMA, 1, f"some{len(rows)}")).collect()))) == plain(rows)
