"""Scores, personal data, languages and the pipeline (operators 2, 5 and 9)."""

import math
import random
import re
import time
import zlib
from collections import Counter

import brute
import numpy as np
import plain_mixing
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import corpus, words

from camtrail.llm import context_mixing, language_id, private_data
from camtrail.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
key = lambda r: tuple((x is None, x) for x in r)


def base_scores(docs):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in docs}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", brute.lower(t)), 0] for _, t in docs]
    counts = Counter(w for (d, _), t in zip(docs, tokens) if not held[d] for w in t)
    n, v = sum(counts.values()), len(counts)
    return [(d, held[d], len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for (d, _), t in zip(docs, tokens)]


def test_base_scores(stored):
    docs = corpus() + [(None, "w1 w2"), (7, "w1"), (7, "w1")]
    held_out = language_id.remainder("doc_id", 10) == 0
    rows = stored([(*d, 0.5) for d in docs], "doc_id long, text string, score double")
    found = context_mixing.text_scores(rows, ~held_out).withColumn("held_out", held_out).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found), key=key)
    for a, b in zip(got, sorted(base_scores(docs), key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_no_texts(stored):
    assert context_mixing.text_scores(stored([]), F.lit(True)).count() == 0
    assert context_mixing.text_scores(stored([(1, "a b")], name="one"), F.lit(False)).first()["n_known"] == 0


def test_scores_beat_the_base_on_held_out_texts(spark):
    found = QUERIES["op2_context_mixing"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_probabilities_of_a_slice_sum_to_one_at_most():
    rng = np.random.default_rng(1)
    tree = np.sort(np.arange(0, 256, dtype=np.uint64) << np.uint64(56))[rng.random(256) < 0.8]
    counts = np.where(rng.random((len(tree), context_mixing.CLASSES)) < 0.4, 0, rng.integers(0, 50, (len(tree), context_mixing.CLASSES)))
    counts[:, 0] += 1
    for depth in (5, 8, 14):  # words that share a leaf, and leaves without words
        total = np.exp(context_mixing.tree_scores(tree, counts, 0, depth)).sum(0)
        assert (total <= 1 + 1e-9).all() and (total > 0.6).all()
    # trees of prefixes, each by itself and all at once
    every = context_mixing.tree_scores(tree, counts, 3)
    apart = [context_mixing.tree_scores(tree[own], counts[own], 3) for p in range(8) for own in [tree >> np.uint64(61) == np.uint64(p)]]
    assert np.allclose(every, np.concatenate(apart), rtol=1e-12)
    sums = np.add.reduceat(np.exp(every), np.flatnonzero(np.diff((tree >> np.uint64(61)).astype(int), prepend=-1)))
    assert (sums <= 1 + 1e-9).all() and (sums > 0.6).all()
    assert context_mixing.tree_scores(tree[:1], counts[:1], 3).tolist() == [[0.0] * context_mixing.CLASSES]


def test_trees_predict_each_node_once(monkeypatch):
    """Not once a word below it, nor again at each level below the first one at which a word is alone."""
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    counts = rng.integers(0, 4, (len(words), context_mixing.CLASSES)) + 1
    want, plain, calls = context_mixing.tree_scores(words, counts, 2), context_mixing._stretch, []
    monkeypatch.setattr(context_mixing, "_stretch", lambda part, whole: calls.append(len(part)) or plain(part, whole))
    assert (context_mixing.tree_scores(words, counts, 2) == want).all()
    crowded = sum(len(np.unique(words >> np.uint64(63 - bit))) for bit in range(2, 15) if len(np.unique(words >> np.uint64(64 - bit))) < len(words))
    assert sum(calls) <= 2 * context_mixing.CLASSES * (1 + context_mixing.PASSES) * (crowded + len(words))
    assert sum(calls) < 0.6 * 2 * context_mixing.CLASSES * (1 + context_mixing.PASSES) * 13 * len(words)


def test_sums_of_a_slices_prefixes():
    rng = np.random.default_rng(6)
    prefixes = np.array([0, 1, 5, 7], np.uint64) << np.uint64(64 - context_mixing.TREE_BITS)
    words = np.unique(np.concatenate([p + rng.integers(0, 1 << 40, 20, dtype=np.uint64) for p in prefixes]))
    known = rng.integers(0, 3, (context_mixing.CLASSES, len(words))).astype(np.uint8)

    def answered(known):
        columns = {"kind": [context_mixing.WORDS], "slice": [0], "block": [3], "first": [0], "last": [9], "hashes": [context_mixing._packed(words)], "known": [known.tobytes()], "n": pa.array([None], pa.binary())}
        return next(r for r in context_mixing._answered(4)(pa.table(columns)).to_pylist() if r["kind"] == context_mixing.STATS)["stats"]

    total, below = known.sum(0), words >> np.uint64(64 - context_mixing.TREE_BITS)
    want = [x for p in np.unique(below) if (total[below == p] > 0).any() for x in (int(p), *known[:, below == p].sum(1).tolist())]
    assert answered(known) == [int((total > 0).sum()), int((total == 1).sum()), *want]
    assert answered(known * 0) == [0, 0]


def test_texts_are_mixed_as_if_alone():
    """Whatever texts are dealt with together: short, long and of whole steps, each gets what a plain loop over its steps gives."""
    rng = np.random.default_rng(7)
    sizes = np.array([1, 16, 17, 300, 2, 32, 299, 16])
    n, first = sizes.sum(), np.cumsum(sizes) - sizes
    seen = rng.integers(0, 30, (n, len(context_mixing.HALF_SEEN)))
    plain, chance = -9 * rng.random(n), rng.random(seen.shape) * (seen > 0)
    found = context_mixing.mixed_logs(plain, seen, chance, first, sizes)
    p, start = np.column_stack([np.exp(plain), chance]), np.column_stack([np.ones(n), seen / (seen + context_mixing.HALF_SEEN)])
    for a, size, got in zip(first, sizes, found):
        moved, total = np.zeros(p.shape[1]), 0.0
        for low in range(a, a + size, context_mixing.STEP_WORDS):
            x = slice(low, min(low + context_mixing.STEP_WORDS, a + size))
            weight = start[x] * np.exp(moved)
            weight /= weight.sum(1, keepdims=True)
            joint = weight * p[x]
            total += np.log(joint.sum(1)).sum()
            moved = np.clip(moved + context_mixing.RATE * (joint / joint.sum(1, keepdims=True) - weight).sum(0), -8, 8)
        assert got == pytest.approx(total, rel=1e-12)
    assert (context_mixing.mixed_logs(plain[:1], seen[:1], chance[:1], first[:1], sizes[:1]) == found[:1]).all()
    assert context_mixing.mixed_logs(plain[:0], seen[:0], chance[:0], first[:0], sizes[:0]).tolist() == []


@pytest.mark.parametrize("most", [40, 1 << 61])
def test_what_came_before(most):
    keys = np.random.default_rng(8).integers(0, 40, 500) * (most // 40)
    before, order, new = context_mixing._before(keys)
    assert before.tolist() == [int((keys[:i] == k).sum()) for i, k in enumerate(keys)]
    assert (order == np.argsort(keys, kind="stable")).all() and new.sum() == len(set(keys.tolist()))
    assert [len(x) for x in context_mixing._before(keys[:0])] == [0, 0, 0]


def test_held_out_texts_change_no_score(stored):
    docs = [(i, words(random.Random(i), 40, 200)) for i in range(60)]
    held = [(1000 + i, words(random.Random(i), 40, 300)) for i in range(20)]
    more = [(2000 + i, words(random.Random(90 + i), 50, 5000)) for i in range(100)]
    trained = F.col("doc_id") < 1000
    one = {r["doc_id"]: r["score"] for r in context_mixing.text_scores(stored(docs + held, files=1, name="one"), trained).collect()}
    two = {r["doc_id"]: r["score"] for r in context_mixing.text_scores(stored(docs + held + more, files=1, name="two"), trained).collect()}
    assert all(two[d] == pytest.approx(s, rel=1e-12) for d, s in one.items())


def test_classes_are_learned_from_all_training_texts(stored):
    docs = [(i, f"own{i} and shared words") for i in range(3000)]
    fitted = []
    for files, order in ((1, docs), (3, docs[::-1])):
        rows = stored(order, files=files, name=f"classes{files}").selectExpr("doc_id as row_id", "text", "doc_id % 10 <> 0 as trained")
        fitted.append(context_mixing.fit_classes(rows))
    assert (fitted[0] == fitted[1]).all()
    learned = pa.array([t for d, t in docs if d % 10])
    features = np.unique(context_mixing.words_of(learned, context_mixing.NOT_SPACE).hash % np.uint64(context_mixing.CLASS_FEATURES)).astype(int)
    assert sorted(np.flatnonzero(fitted[0].sum(1))) == features.tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_are_those_of_the_plain_mixture(stored, seed):
    rng = random.Random(seed)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([0, 1, 2, 15, 40, 90])))) for i in range(40)] + [(90, "never seen never seen w1 w1 new"), (91, "x x x x x x")]
    learn = lambda d: d % 5 != 0 and d < 90
    rows = stored(docs).withColumn("trained", F.expr("doc_id % 5 <> 0 and doc_id < 90"))
    found = {r["doc_id"]: r["score"] for r in context_mixing.text_scores(rows.select("doc_id", "text"), F.expr("doc_id % 5 <> 0 and doc_id < 90")).collect()}
    classes = context_mixing.fit_classes(rows.selectExpr("doc_id as row_id", "text", "trained"))
    hashes = [context_mixing.words_of(pa.array([t]), context_mixing.NOT_SPACE).hash for _, t in docs]
    own = [int((context_mixing._features(h) @ classes).argmax()) for h in hashes]
    want = plain_mixing.scores([[*map(int, h), int(context_mixing.END)] for h in hashes], [learn(d) for d, _ in docs], own)
    assert [found[d] for d, _ in docs] == pytest.approx(want, rel=1e-6)


def test_class_cosines_cost():
    """The cosines that k-means takes in each round are those of a plain sum over features, by array operations that run along texts, not across centroids."""
    rng = np.random.default_rng(5)
    sizes, centroids = rng.integers(1, 300, 2000), rng.random((context_mixing.CLASS_FEATURES, context_mixing.CLASSES))
    lists = [(rng.integers(0, context_mixing.CLASS_FEATURES, n).astype("<u2"), rng.integers(1, 1 << 15, n).astype("<u2")) for n in sizes]
    batch = pa.record_batch([pa.array([x[i].tobytes() for x in lists], pa.binary()) for i in (0, 1)], ["features", "units"]).slice(7)

    def plain():
        features, units = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2") for c in ("features", "units"))
        return np.add.reduceat(centroids[features] * (units * context_mixing.UNIT)[:, None], np.cumsum(sizes[7:]) - sizes[7:], axis=0)

    def least(run):
        return min(-time.process_time() + (run(), time.process_time())[1] for _ in range(7))

    features, units, cosines = context_mixing._cosines(batch, centroids)
    assert (features == np.concatenate([f for f, _ in lists[7:]])).all() and (units == np.concatenate([u for _, u in lists[7:]])).all()
    assert np.allclose(cosines, plain(), rtol=1e-12)
    assert least(lambda: context_mixing._cosines(batch, centroids)) < 0.7 * least(plain)


def plain_cosines(text, model):
    """Cosine of a text's trigrams with each centroid, and the share of the way to its radius, by plain sums."""
    letters = [x if chr(x).isalpha() or x >= 0x80 else 0x20 for x in (text or "").encode()]
    letters = [0x20, *(x + 32 if 0x41 <= x <= 0x5A else x for x in letters), 0x20]
    counts = Counter()
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        code = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)
        counts[(code * 0x27D4EB2F & 0xFFFFFFFF) >> 19] += 1
    vector = {f: math.log(1 + n) * model.idf[f] for f, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in vector.values()))
    cosines = [sum(v / norm * float(w[f]) for f, v in vector.items()) for w in model.weights.T]
    level = math.log2(len(counts))
    radius = [r[int(level)] + (level - int(level)) * (r[min(int(level) + 1, len(r) - 1)] - r[int(level)]) for r in model.radius]
    return cosines, [c < r for c, r in zip(cosines, radius)]


def test_languages_are_those_of_the_nearest_centroid(stored):
    rng = random.Random(5)
    syllables = {"xx": ["ba", "ka", "to"], "yy": ["üm", "ön", "äsch"], "zz": ["ba", "rel", "im"]}
    docs = [(i, "".join(rng.choices([" ", *syllables[lang]], k=rng.choice([2, 9, 60]))), lang) for i in range(240) for lang in [("xx", "yy", "zz")[i % 3]]]
    docs += [(1000, "Strange qwrt pfgh", None), (1001, "BA 1 ka", None), (1002, "é", None), (1003, "xq" * 4000, None)]
    rows = stored(docs, "doc_id long, text string, lang string")
    model = language_id.fit(rows)
    texts = [t for _, t, lang in docs if lang]
    held = [set(f.tolist()) for f, _ in language_id._trigram_counts(pa.array(texts))]
    assert model.idf == pytest.approx([math.log((len(texts) + 2) / (1 + sum(f in h for h in held))) + 1 for f in range(language_id.FEATURES)])
    found = {r["doc_id"]: r for r in language_id.predict(rows, model).collect()}
    for doc_id, text, _ in docs:
        r = found[doc_id]
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        cosines, outside = plain_cosines(text, model)
        assert r["score"] == pytest.approx(max(0.0, max(cosines)), abs=1e-6) and r["rejected"] == all(outside)
        near = {model.languages[k] for k, c in zip(model.language, cosines) if c > max(cosines) - 1e-6}
        assert r["lang_pred"] in near


def test_scores_follow_from_the_training_texts_alone(stored, monkeypatch):
    """More training texts than the sample, held-out ones before them, in another order, in more slices."""
    docs = [(i, words(random.Random(i), 1 + i % 40, 300)) for i in range(2000)] + [(3000 + i, "one text that is copied") for i in range(300)]
    held = [(5000 + i, words(random.Random(-i), 30, 500)) for i in range(200)]
    trained = F.col("doc_id") < 5000
    score = lambda rows, name: {r["doc_id"]: r["score"] for r in context_mixing.text_scores(stored(rows, files=1, name=name), trained).collect()}
    one = score(docs, "one")
    monkeypatch.setattr(context_mixing, "SLICE_BYTES", 1 << 9)
    two = score(held + docs[::-1], "two")
    assert all(two[d] == pytest.approx(s, rel=1e-9) for d, s in one.items())


def test_all_words_of_a_model_and_the_unknown_ones_sum_to_one_at_most(stored):
    """One-word texts, scored by a model of others: the mass of known words, and of unknown ones as a single event."""
    rng = random.Random(3)
    names = [f"n{i}" for i in range(80)]
    docs = [(i, " ".join(rng.choices(names, range(80, 0, -1), k=30))) for i in range(50)]
    known = sorted({w for _, t in docs for w in t.split()})
    asked = [(1000 + i, w) for i, w in enumerate([*known, "never", "other"])]
    found = {r["doc_id"]: r for r in context_mixing.text_scores(stored(docs + asked), F.col("doc_id") < 1000).collect()}
    assert found[1000 + len(known)]["score"] == pytest.approx(found[1001 + len(known)]["score"])
    # a text is its word and its end: both together are no likelier than the word alone
    assert sum(10 ** found[1000 + i]["score"] for i in range(len(known) + 1)) <= 1 + 1e-9


def test_word_order_counts(stored):
    rng = random.Random(8)
    names = [f"w{i}" for i in range(60)]
    follows = {w: rng.sample(names, 2) for w in names}

    def chain():
        out = [rng.choice(names)]
        while len(out) < 80:
            out.append(rng.choice(follows[out[-1]]))
        return out

    docs = [(i, " ".join(chain())) for i in range(200)]
    held = [chain() for _ in range(5)]
    docs += [(1000 + i, " ".join(t)) for i, t in enumerate(held)] + [(2000 + i, " ".join(rng.sample(t, len(t)))) for i, t in enumerate(held)]
    docs += [(3000, docs[0][1]), (3001, docs[0][1])]
    found = {r["doc_id"]: r["bits"] for r in context_mixing.text_scores(stored(docs), ~F.col("doc_id").between(1000, 2999)).collect()}
    assert all(found[1000 + i] < 0.6 * found[2000 + i] for i in range(5))
    assert found[3000] == pytest.approx(found[3001]) and found[3000] == pytest.approx(found[0])


def test_mixed_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    k = len(context_mixing.HALF_SEEN)
    base, counts = rng.dirichlet(np.ones(6)), rng.integers(0, 5, (6, k))
    history = np.log(rng.random(40)), rng.integers(0, 9, (40, k)).astype(float)
    logs = []
    for w in range(6):
        plain = np.append(history[0], np.log(base[w]))
        seen = np.concatenate([history[1], counts.sum(0)[None]])
        chance = np.concatenate([np.minimum(1, history[1] / 9), (counts[w] / np.maximum(counts.sum(0), 1))[None]])
        logs.append([context_mixing.mixed_logs(plain[:n], seen[:n], chance[:n], np.zeros(1, int), np.array([n]))[0] for n in (40, 41)])
    assert np.exp([b - a for a, b in logs]).sum() == pytest.approx(1)


PIECES = st.lists(st.sampled_from(["a@b.c", "x.y+z@q-1.example.com", "@", "_d@e.f", "1.2.3.4", "999.1.1.1", "0255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1", " ", ".", "-", "7", "é", "z"]), max_size=12)


@settings(max_examples=500, deadline=None)
@given(st.one_of(PIECES.map("".join), st.text("+(). -0123456789@ab_%", max_size=60)))
def test_base_spans(text):
    assert [(private_data.KINDS[k], a, b) for a, k, b in private_data.base_spans(text)] == brute.private(text)


def test_spans_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 200_000, "a@" + "b" * 200_000):
        private_data.base_spans(text)


def test_personal_data(stored):
    docs = corpus() + [(6000, "☃ write a@b.example.com or +1 (555) 123-4567"), (None, "1.2.3.4"), (None, None)]
    docs += [(6100 + i, f"call Zorblatt at zb@x.example.org {words(random.Random(i), 30)}") for i in range(5)]
    docs += [(6200 + i, f"the word at {words(random.Random(50 + i), 30)} the call") for i in range(30)]
    rows = stored([(*d, "k") for d in docs], "doc_id long, text string, spans string")
    found = private_data.personal_data(rows, clean=True).collect()
    base = lambda spans: [(private_data.KINDS[s["kind"]], s["start"], s["end"]) for s in spans if s["kind"] < 4]
    want = sorted(((d, brute.private(t)) for d, t in docs), key=key)
    assert sorted(((r["doc_id"], base(r["spans"])) for r in found), key=key) == want
    clean = {r["doc_id"]: r["clean_text"] for r in found}
    assert clean[6000] == "☃ write <email> or <phone>"
    assert all(clean[6100 + i].startswith("<term> <email> ") for i in range(5))
    assert all(clean[6200 + i] == dict(docs)[6200 + i] for i in range(30))
    assert private_data.personal_data(stored([], name="none")).count() == 0


def disclosing(docs):
    """The plain rule: which words and pairs of words reveal which entities, as (term, entity)."""
    pairs = lambda side: [*side, *(f"{a} {b}" for a, b in zip(side, side[1:]))]
    key = re.compile("[A-Za-z0-9]{20,}")
    met, has, distinct = {}, {}, {}
    for n, text in enumerate(docs):
        found = [(m.start(), m.end(), w) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text)) for w in [m[0]]]
        for t in pairs([w for _, _, w in found]):
            has.setdefault(t, set()).add(n)
        spans = [(a, b, k) for a, k, b in private_data.base_spans(text)]
        spans += [(a, b, private_data.KEY) for a, b, w in found if key.fullmatch(w) and re.search("[0-9]", w) and re.search("[a-z]", w)]
        for a, b, kind in spans:
            near = pairs([w for _, y, w in found if y <= a][-private_data.NEAR :]) + pairs([w for x, _, w in found if x >= b][: private_data.NEAR])
            for entity in private_data.entities_of(text[a:b].lower(), kind):
                for w in near:
                    met.setdefault((w, entity), set()).add(n)
                distinct.setdefault(entity, set()).add(n)
    out = set()
    for (w, entity), both in met.items():
        given, alone = len(both) / len(has[w]), len(distinct[entity]) / len(docs)
        if len({docs[n] for n in both}) >= private_data.SUPPORT and given >= private_data.HALF and math.log2(given / alone) / math.log2(1 / alone) >= private_data.DISCLOSED:
            out.add((w, entity))
    return out


@pytest.mark.parametrize("block", [private_data.TERM_BLOCK, 0])
def test_disclosing_terms(stored, monkeypatch, block):
    monkeypatch.setattr(private_data, "TERM_BLOCK", block)
    rng = random.Random(6)
    texts = [words(rng, 30, 150) for _ in range(120)]
    texts += [f"{words(rng, 9, 150)} token = {rng.getrandbits(160):040x}a1 {words(rng, 9, 150)}" for _ in range(6)]
    texts += [f"{words(rng, 9, 150)} Zorblatt@ {'x' * 90}{i % 2} é zb{i}@mail.example.com {words(rng, 9, 150)}" for i in range(6)]
    texts += [f"ring desk +1 (555) 12{i}-4567 {words(rng, 9, 150)}" for i in range(5)] + ["ring 10.0.0.1 now"] * 4
    want = disclosing(texts)
    rows = stored([(i, t) for i, t in enumerate(texts)])
    found = private_data.revealing_terms(private_data.numbered(rows)).collect()
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    hashes = lambda *w: private_data._terms_by_text(private_data.words_of(pa.array([" ".join(w)]), private_data.ALNUM))[0].view(np.int64)
    lists = [re.findall(word, brute.lower(t)) for t in texts]
    term_of = {int(hashes(w)[0]): w for own in lists for w in own} | {int(hashes(a, b)[2]): f"{a} {b}" for own in lists for a, b in zip(own, own[1:])}
    entities = {private_data._entity(e): e for _, e in want}
    assert {(term_of[r["term"]], entities.get(r["entity"])) for r in found} == want
    assert {"token", "zorblatt", "desk", "ring desk"} <= {w for w, _ in want} and "ring" not in {w for w, e in want if e == "phone"}
    terms = {w for w, _ in want}
    marked = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == private_data.TERM] for r in private_data.personal_data(rows).collect()}
    for i, text in enumerate(texts):
        places = [m.span() for m in re.finditer(word, brute.lower(text))]
        own = sorted([(a, z) for (a, z), w in zip(places, lists[i]) if w in terms] + [(a, z) for (a, _), (_, z), v, w in zip(places, places[1:], lists[i], lists[i][1:]) if f"{v} {w}" in terms])
        runs = []
        for a, z in own:
            if runs and a < runs[-1][1]:
                runs[-1] = (runs[-1][0], max(z, runs[-1][1]))
            else:
                runs.append((a, z))
        base = private_data.base_spans(text)
        assert marked[i] == [(a, z) for a, z in runs if not any(x <= a and z <= y for x, _, y in base)]


def test_many_spans_take_linear_time():
    text = "é write a.b@c.example token 1234567890123456789012345678ab 1.2.3.4 " * 75_000
    batch = pa.record_batch([pa.array([text])], ["__text"])
    held = type("Held", (), {"value": np.sort(private_data._terms_by_text(private_data.words_of(pa.array(["token write"]), private_data.ALNUM))[0])})
    begun = time.process_time()
    (found,) = private_data._marked(held, (), True)([batch])
    assert len(found["spans"][0]) == 5 * 75_000 and time.process_time() - begun < 15
    next(private_data._contexts(8)([pa.record_batch([batch["__text"], pa.array([1])], ["text", "row_id"])]))
    assert time.process_time() - begun < 40


def test_languages(stored):
    rng = random.Random(3)
    syllables = {"xx": ["ba", "ka", "to"], "yy": ["üm", "ön", "äsch"]}
    docs = [(i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(20)), lang) for i in range(200) for lang in [("xx", "yy")[i % 2]]]
    docs += [(500, None, "xx"), (501, "", None), (502, "123 !?", "yy"), (None, docs[0][1], None), (504, "баба кука", None)]
    rows = stored([(*d, 1.0) for d in docs], "doc_id long, text string, lang string, score double")
    model = language_id.fit(rows.where(language_id.remainder("doc_id", 4) != 2))
    found = {r["doc_id"]: r for r in language_id.predict(rows, model).collect()}
    assert all(found[i]["lang_pred"] == lang and not found[i]["rejected"] and 0 < found[i]["score"] <= 1 for i, _, lang in docs[:200])
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] and found[i]["score"] == 0 for i in (500, 501, 502))
    assert found[None]["lang_pred"] == docs[0][2]
    nothing = language_id.fit(stored([], "doc_id long, text string, lang string", name="none"))
    assert language_id.predict(rows, nothing).where("lang_pred <> 'und'").count() == 0


def test_far_texts_are_rejected_and_learned_languages_stay(spark, stored):
    rng = random.Random(4)
    cyrillic, latin = "абвгдежзиклмнопрстуфхцчшыэюя", "abcdefghijklmnopqrstuvwxyz"
    strange = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(n))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(language_id.remainder("doc_id", 4) != 2))
    far = stored([(i, strange((cyrillic, latin)[i % 2], n)) for i, n in enumerate([10, 10, 20, 20, 100, 100, 1000, 1000, 5000, 5000])])
    assert all(r["rejected"] for r in language_id.predict(far, model).collect())
    assert language_id.predict(docs.where(r"text rlike '\\p{L}'"), model).where("rejected").count() == 0


def test_a_text_of_one_letter_has_a_language(stored):
    rows = stored([(i, lang, t) for i, (lang, t) in enumerate([("xx", "a b a"), ("yy", "ü ö ü")] * 3 + [(None, "a"), (None, "z"), (None, "."), (None, "")])], "doc_id long, lang string, text string")
    found = {r["doc_id"]: r for r in language_id.predict(rows, language_id.fit(rows)).collect()}
    assert found[6]["lang_pred"] == "xx" and found[6]["score"] > 0 and not found[6]["rejected"]
    assert found[7]["lang_pred"] != "und"
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] for i in (8, 9))
    assert [len(f) for f, _ in language_id._trigram_counts(pa.array(["a", "", "ab", None, "b"]))] == [1, 0, 2, 0, 1]


def test_held_out_languages(spark):
    found = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert found.join(known, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_queries_return_the_contracts_columns(spark):
    kinds = {
        "op1_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op2_context_mixing": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
        "op3_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op4_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op5_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op6_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op7_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op8_repeated_bytes": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
        "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op10_bpe_encode_decode": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    }
    kinds |= {
        "op11_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
        "op12_web_archives": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
        "op13_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    }
    assert set(kinds) == set(QUERIES)
    for name, want in kinds.items():
        assert want.items() <= dict(QUERIES[name](spark, SF_DIR).dtypes).items()
