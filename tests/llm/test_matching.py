"""N-gram join, decontamination, repeated bytes and top-k (operators 1, 6, 7 and 8) against plain versions."""

import random

import brute
import pytest
from samples import corpus, words

from camtrail.llm import decontaminate, ngram_join, repeats, vector_search
from pyspark.sql import functions as F

key = lambda r: tuple((x is None, x) for x in r)


def near_copies(seed=5):
    """A large group of near copies, of which many do not link with each other, beside the corpus."""
    rng = random.Random(seed)
    base = words(rng, 100, 5000).split()
    docs = corpus(seed)
    for i in range(150):
        parts = list(base)
        for _ in range(rng.randrange(1, 9)):
            parts[rng.randrange(len(parts))] = f"v{rng.randrange(10**6)}"
        docs.append((2000 + i, " ".join(parts)))
    return docs


@pytest.mark.parametrize("n, percent, frequent", [(4, 85, 48), (5, 80, 3), (2, 60, 3)])
def test_jaccard(stored, monkeypatch, n, percent, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    docs = near_copies()
    found = ngram_join.jaccard_components(stored(docs), n, percent).collect()
    want = [(d, *r) for (d, _), r in zip(docs, brute.linked(docs, n, percent))]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(want)


def test_jaccard_pairs(stored):
    docs = near_copies()
    table = stored(docs)
    sets = {r["set_id"]: r["doc_id"] for r in ngram_join.jaccard_components(table).where("n_shingles > 0").collect()}
    text = dict(docs)
    grams = {s: {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for s, d in sets.items() for w in [brute.lower(text[d]).split()]}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(grams[a] & grams[b]) >= 85 * len(grams[a] | grams[b])}
    assert {tuple(r) for r in ngram_join.jaccard_pairs(table).collect()} == want


def test_links_of_a_group_grow_with_its_size(stored, monkeypatch):
    counts = []
    kept = ngram_join.Verifier.links

    def links(self, pairs):
        counts.append(pairs.count())
        return kept(self, pairs)

    monkeypatch.setattr(ngram_join.Verifier, "links", links)
    for m in (150, 600):
        rng, base = random.Random(m), words(random.Random(1), 100, 5000).split()
        docs = [(i, " ".join([*base[:k], f"v{i}", *base[k + 1 :]])) for i in range(m) for k in [rng.randrange(100)]]
        counts.append(0)
        found = ngram_join.jaccard_components(stored(docs, name=f"group{m}"))
        assert found.where("component_id = 0").count() == m
        assert sum(counts[-len(counts) + counts.index(0) :]) < 40 * m
        counts.clear()


def test_pairs_of_a_group_of_variants_grow_with_its_size(stored, monkeypatch):
    """Five places of four variants: most pairs don't link, but chains of links join all."""
    counts, kept = [], ngram_join.Verifier.links

    def links(self, pairs):
        counts.append(pairs.count())
        return kept(self, pairs)

    monkeypatch.setattr(ngram_join.Verifier, "links", links)
    base = words(random.Random(1), 120, 5000).split()
    for m in (400, 1600, 4000):
        rng, docs = random.Random(m), []
        for i in range(m):
            text = list(base)
            for place in (10, 35, 60, 85, 110):
                text[place] = f"v{place}x{rng.randrange(4)}"
            docs.append((i, " ".join(text)))
        counts.clear()
        found = ngram_join.jaccard_components(stored(docs, name=f"variants{m}"))
        assert found.where("component_id = 0").count() == m
        assert sum(counts) < 25 * m


@pytest.mark.parametrize("broadcast", [ngram_join.BROADCAST_ROWS, 20])
def test_common_passages_index_their_texts_again_and_extend_nothing(stored, monkeypatch, broadcast):
    """Passages that no batch holds often enough to tell: their shingles pass for rare, and all texts with one meet there."""
    monkeypatch.setattr(ngram_join, "LOCAL", 10**9)
    monkeypatch.setattr(ngram_join, "FREQUENT", 10)
    monkeypatch.setattr(ngram_join, "MOST_PAIRS", 100)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", broadcast)
    extended = []
    monkeypatch.setattr(ngram_join, "_extended", lambda *args: extended.append(args))
    rng = random.Random(3)
    passages = [words(rng, 14, 5000).split() for _ in range(3)]
    docs = []
    for i in range(120):
        own = words(rng, 30, 10**6).split()
        docs.append((i, " ".join([*own[:9], *passages[i % 3], *own[9:]])))
    for i in range(0, 120, 5):  # near copies, and copies
        text = docs[i][1].split()
        text[rng.randrange(len(text))] = f"v{i}"
        docs += [(1000 + i, " ".join(text)), (2000 + i, docs[i][1])]
    found = ngram_join.jaccard_components(stored(docs)).collect()
    want = [(d, *r) for (d, _), r in zip(docs, brute.linked(docs, 4, 85))]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(want)
    assert not extended


def test_entries_are_shuffled_once(spark, monkeypatch):
    """Those of a single set are told apart where entries meet, without a second shuffle of all."""
    monkeypatch.setattr(ngram_join, "written", lambda df, *args, **more: df)
    entries = spark.createDataFrame([(1, 10, 5, 0, 0), (1, 11, 5, 0, 0), (2, 10, 5, 1, 1), (3, 11, 5, 1, 1)], ngram_join._ENTRY_SCHEMA)
    shared = ngram_join._shared(entries)
    assert shared._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(tuple(r) for r in shared.collect()) == [(1, 10, 5, 0, 0), (1, 11, 5, 0, 0)]


def test_entries_drop_members_that_can_not_link(spark, monkeypatch):
    """Sets whose sizes or places of the entry's tokens rule a link out with all others of the entry go no further; no pair that may link is lost."""
    monkeypatch.setattr(ngram_join, "written", lambda df, *args, **more: df)
    apart = [(1, 10, 100, 0, 0), (1, 11, 50, 0, 0), (2, 10, 100, 10, 10), (2, 11, 100, 1, 1)]
    rng = random.Random(3)
    rows = apart + [(e, s, size, m := rng.randrange(1 + size // 6), m) for e in range(3, 300) for s in range(rng.randrange(1, 6)) for size in (rng.randrange(20, 60),)]
    shared = {tuple(r) for r in ngram_join._shared(spark.createDataFrame(rows, ngram_join._ENTRY_SCHEMA)).collect()}
    may = lambda a, b: 185 * min(a[2] - a[3], b[2] - b[3]) >= 85 * (a[2] + b[2])
    able = {a for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and may(a, b)}
    assert able and able <= shared < set(rows) and not shared & set(apart)
    several = {e for e in range(300) if sum(r[0] == e for r in rows) > 2}
    assert {r for r in shared if r[0] not in several} == {r for r in able if r[0] not in several}


def test_words_that_defeat_polynomial_hashes(stored):
    turn = str.maketrans("ab", "ba")
    word = lambda n, t="a": t if len(t) >= n else word(n, t + t.translate(turn))
    docs = [(i, t) for n in (512, 1024, 4096, 8192) for i, t in ((n, word(n)), (n + 1, word(n).translate(turn)))]
    assert all(r["doc_id"] == r["component_id"] for r in ngram_join.jaccard_components(stored(docs)).collect())
    hits = decontaminate.contamination(stored(docs), stored([(1, docs[2][1])], "item_id long, text string", name="items"))
    assert {r["doc_id"] for r in hits.where("n_hit > 0").collect()} == {1024}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in repeats.deduplicated(stored(docs)).collect()}
    assert [got[d] for d, _ in docs] == brute.repeated_bytes(docs)


def test_jaccard_of_odd_rows(stored):
    docs = [(5, "a b c d e"), (3, "A b c d E"), (3, "A b c d E"), (None, "a b c d e"), (None, None), (9, None), (None, "q")]
    rows = stored([(*d, 1, "x") for d in docs], "doc_id long, text string, size int, entry string")
    found = ngram_join.jaccard_components(rows).collect()
    want = [(5, 2, 3), (3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 0, None), (9, 0, 9), (None, 1, None)]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=key) == sorted(want, key=key)
    assert ngram_join.jaccard_components(stored([], name="none")).count() == 0


def test_decontamination(stored):
    rng = random.Random(2)
    items = [(i, words(rng, k, 60)) for i, k in enumerate([1, 2, 5, 12, 13, 14, 30, 50])] + [(20, None), (21, "..."), (None, "a b"), (22, "Ünï ÇÖ x"), (4, words(rng, 20, 60))]
    docs = corpus() + [(3000 + i, f"{words(rng, 20, 60)} {t.upper() if i % 2 else t} {words(rng, 9, 60)}") for i, (_, t) in enumerate(items) if t]
    docs += [(3100, items[7][1][:-4]), (3101, " ".join(items[7][1].split()[5:25])), (None, items[6][1]), (3101, "zz")]
    rows, tests = stored([(*d, 0) for d in docs], "doc_id long, text string, n_words int"), stored(items, "item_id long, text string", 2, "benchmark")
    found = decontaminate.contamination(rows, tests).collect()
    want = [(d, *r) for (d, _), r in zip(docs, brute.decontaminate(docs, items))]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=key) == sorted(want, key=key)


def test_decontamination_of_nothing(stored):
    docs, none = stored(corpus(n=5)), stored([], "item_id long, text string", 1, "benchmark")
    assert decontaminate.contamination(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(stored([], name="none"), none).count() == 0


@pytest.mark.parametrize("alignments", [decontaminate.BROADCAST_ALIGNMENTS, 0])
def test_decontamination_in_blocks(stored, monkeypatch, alignments):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    monkeypatch.setattr(decontaminate, "BROADCAST_ALIGNMENTS", alignments)
    rng = random.Random(4)
    items = [(i, words(rng, 25, 90)) for i in range(12)]
    docs = [(i, f"{words(rng, 30, 90)} {items[i % 12][1]} {items[(i + 1) % 12][1]}") for i in range(20)]
    found = decontaminate.contamination(stored(docs), stored(items, "item_id long, text string", 1, "benchmark")).collect()
    want = [(d, *r) for (d, _), r in zip(docs, brute.decontaminate(docs, items))]
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found) == sorted(want)


def test_proximity(stored):
    import numpy as np
    import pyarrow as pa

    from camtrail.llm.tables import numbered
    from camtrail.llm.text_arrays import ALNUM, words_of

    docs = numbered(stored([(1, "a x x b"), (2, "a x x x b"), (3, "b a")]))
    terms = words_of(pa.array(["a b"]), ALNUM).hash
    index = decontaminate.positional_index(docs, np.sort(terms))
    near = decontaminate.proximity(index, terms.astype(np.int64).tolist(), 3).join(docs, "row_id").select("doc_id", "position").collect()
    assert sorted(map(tuple, near)) == [(1, 0), (3, 1)]


@pytest.mark.parametrize("length, gram", [(100, 32), (20, 7), (8, 8)])
def test_repeats(stored, length, gram):
    docs = near_copies() + [(4000 + i, "ab" * 60 + t) for i, t in enumerate(("", "q", "abab", "漢" * 50))]
    found = repeats.deduplicated(stored(docs, files=6), length, gram)
    digests = found.select("doc_id", "n_bytes", "n_removed", F.size("removed").alias("n_spans"), "kept_sha256").collect()
    want = [(d, *r) for (d, _), r in zip(docs, brute.repeated_bytes(docs, length))]
    assert sorted(map(tuple, digests)) == sorted(want)
    kept = {r["doc_id"]: bytes(r["kept"]) for r in found.collect()}
    assert {d: brute.sha(k) for d, k in kept.items()} == {w[0]: w[4] for w in want}


def test_repeats_of_odd_rows(stored):
    text = words(random.Random(1), 60, 10**6)
    docs = [(1, text), (1, text), (None, text), (2, None), (None, None)]
    found = repeats.deduplicated(stored([(*d, 0) for d in docs], "doc_id long, text string, row_id int")).select("doc_id", "n_removed").collect()
    n = len(text)
    assert sorted(map(tuple, found), key=key) == sorted([(None, 0), (1, n), (1, n), (2, 0), (None, 0)], key=key)
    assert repeats.deduplicated(stored([], name="none")).count() == 0


def ranked(vectors, k=10):
    import math

    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(good):
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(good) if m != n and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("copies, pairs, held", [(0, 1 << 20, 1 << 20), (300, 1 << 20, 10), (300, 0, 1 << 20)])
def test_top_k(stored, monkeypatch, copies, pairs, held):
    monkeypatch.setattr(vector_search, "BROADCAST_PAIRS", pairs)
    monkeypatch.setattr(vector_search, "HELD_CANDIDATES", held)
    rng = random.Random(7)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(350)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(copies)] + [(5000, [float("nan")] * 8), (5100, [None] * 8), (5200, None), (5300, [1.0, 2.0]), (5301, [1.0, 0.5]), (5400, [])]
    clash = "vec_id long, embedding array<double>, row_id string, score string, query string, cells string, vector string"
    found = vector_search.top_k(stored([(*v, *"abcde") for v in vectors], clash), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, found)) == sorted(ranked(vectors))


def test_top_k_of_few(stored, monkeypatch):
    rows = stored([(0, [1.0, 2.0]), (7, [0.5, 0.5]), (100, [1.0, 2.0])], "vec_id long, embedding array<double>")
    found = vector_search.top_k(rows, F.col("vec_id") % 100 == 0, block=1).collect()
    assert sorted(map(tuple, found)) == sorted(ranked([(0, [1.0, 2.0]), (7, [0.5, 0.5]), (100, [1.0, 2.0])]))
    assert vector_search.top_k(stored([], "vec_id long, embedding array<double>", name="none"), F.col("vec_id") % 100 == 0).count() == 0


def test_row_numbers_do_not_follow_the_splits(spark, stored, monkeypatch):
    from camtrail.llm import tables
    from camtrail.llm.tables import numbered

    docs = stored([(i % 7, f"text {i}") for i in range(300)])
    numbers = lambda d: {r["row_id"]: (r["doc_id"], r["text"]) for r in numbered(d).collect()}
    want = numbers(docs)
    assert sorted(want.values()) == sorted((r["doc_id"], r["text"]) for r in docs.collect())
    monkeypatch.setattr(tables, "MOST_PATH_BYTES", 0)  # paths too many to broadcast
    assert numbers(docs) == want
    settings = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert numbers(docs) == want
        few = numbers(docs.where("doc_id = 3").select("doc_id", "text"))
        assert few == {k: v for k, v in want.items() if v[0] == 3}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rounds_shuffle_members_of_entries_once_and_no_join_makes_them_again(stored, spark, monkeypatch):
    """Members learn their entry's components and leader in one shuffle by entry; entries of two are settled by one comparison."""
    plans, kept = {}, ngram_join.written

    def written(df, name, **more):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name, **more)

    monkeypatch.setattr(ngram_join, "written", written)
    classes = spark.createDataFrame([(s, s) for s in range(1, 8)], "sid long, row_id long")
    found = ngram_join._Grouping(classes, None)
    found.labels = stored([(s, 1 if s < 4 else s) for s in range(1, 8)], "sid long, component long", name="labels")
    members = {1: (1, 2, 3), 2: (1, 2, 4, 5), 3: (6, 7), 4: (2, 3, 6)}
    entries = stored([(e, s, 10, 0, 0) for e, sids in members.items() for s in sids], ngram_join._ENTRY_SCHEMA, name="entries")
    left = found.unsettled(entries, 1, least=3)
    assert {(r["entry"], r["sid"], r["component"], r["largest"], r["members"], r["outside"]) for r in left.collect()} == {
        (2, 1, 1, 1, 4, 2), (2, 2, 1, 1, 4, 2), (2, 4, 4, 1, 4, 2), (2, 5, 5, 1, 4, 2), (4, 2, 1, 1, 3, 1), (4, 3, 1, 1, 3, 1), (4, 6, 6, 1, 3, 1),
    }
    leaders = {(r["entry"], r["leader"]["sid"]) for r in left.collect()}
    assert len(leaders) == 2 and leaders <= {(2, 1), (2, 2), (4, 2), (4, 3)}
    assert {r["entry"] for r in found.unsettled(entries, 1).collect()} == {2, 3, 4}
    assert all(p.count("hashpartitioning(entry") == 1 and "hashpartitioning(entry#" in p and "Join [entry" not in p for p in plans["left"])
    pairs = ngram_join._leaders(left, 85)
    assert {b for _, b in pairs.collect()} == {4, 5, 6} and "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    first = ngram_join._leaders(ngram_join._led(entries.withColumn("component", F.col("sid")), 0, F.lit(True)), 85)
    assert first.count() == 2 + 3 + 1 + 2 and "Join" not in first._jdf.queryExecution().executedPlan().toString()
