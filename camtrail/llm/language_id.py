"""Language identification by nearest centroid (operator 9).

Texts become vectors of hashed byte trigrams of lower-cased letters, weighted by TF-IDF and normalised. Document
frequencies are counted over all training texts. On a sample of them, of about SAMPLE a language, each language's
vectors are clustered into several centroids (spherical k-means). A text gets the language of the centroid of highest
cosine. It is rejected if it lies outside the radius of every centroid. A radius is half a low quantile of the cosines
that the centroid's own sample members have, learned for each text length (from whole members and from parts of them):
short texts share few trigrams with anything, and long ones share some with everything by collisions alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from camtrail.llm.tables import small_batches
from camtrail.llm.text_arrays import LOWER, joined

FEATURES = 1 << 13
#: Rows a language in the fitted sample, on average: the only bound of the fit. Languages have all their rows if fewer.
SAMPLE = 400
#: How often copies of a text in it count at most.
COPIES = 8
CENTROIDS = 4
ROUNDS = 12
SLACK = 0.5
LOW = 0.01
#: Radii are learned for texts of 1, 2, 4 and so on features; from the language's members where a centroid has fewer than MEMBERS.
LEVELS = FEATURES.bit_length()
MEMBERS = 20
UNKNOWN = "und"
_LETTER = np.where(np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]), LOWER, 0x20).astype(np.uint32)


def _trigram_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The features of each text, with a space on either side, and how often it has them."""
    data, offsets = joined(texts)
    letters = np.concatenate([np.full(1, 0x20, np.uint32), _LETTER[data]])  # so a space stands before each text
    if len(letters) < 3:
        yield from ((np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(texts)))
        return
    code = (letters[:-2] * np.uint32(0x9E3779B1)) ^ (letters[1:-1] * np.uint32(0x85EBCA77)) ^ (letters[2:] * np.uint32(0xC2B2AE3D))
    feature = ((code * np.uint32(0x27D4EB2F)) >> np.uint32(19)).astype(np.int64)
    for a, b in zip(offsets[:-1], offsets[1:]):
        counts = np.bincount(feature[a : b - 1], minlength=FEATURES)
        held = np.flatnonzero(counts)
        yield held, counts[held]


@dataclass
class Centroids:
    languages: list[str]
    weights: np.ndarray  # one column a centroid
    language: np.ndarray  # of each centroid
    radius: np.ndarray  # a row a centroid, a column a level of length
    idf: np.ndarray

    def vector(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf[features]
        return v / max(np.linalg.norm(v), 1e-12)

    def nearest(self, features: np.ndarray, counts: np.ndarray) -> tuple[str | None, float, bool]:
        """Language, cosine and whether it is too far; None without features or centroids."""
        if not len(features) or not len(self.language):
            return None, 0.0, True
        cosines = self.vector(features, counts) @ self.weights[features]
        best = int(cosines.argmax())
        level = np.log2(len(features))
        low, high = int(level), min(int(level) + 1, LEVELS - 1)
        radius = self.radius[:, low] + (level - low) * (self.radius[:, high] - self.radius[:, low])
        return self.languages[self.language[best]], float(min(1.0, max(0.0, cosines[best]))), bool((cosines < radius).all())


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts = np.zeros(FEATURES, np.int64), 0
    for part in small_batches(batches, "text", 2 << 20):
        for held, _ in _trigram_counts(part["text"]):
            total[held] += 1
            texts += 1
    yield pa.record_batch([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(total, texts))], ["feature", "n"])


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in small_batches(batches, "text", 2 << 20):
        found = list(_trigram_counts(part["text"]))
        yield pa.record_batch([part["lang"], part["n"], pa.array([f.astype("<u2").tobytes() for f, _ in found]), pa.array([c.astype("<i4").tobytes() for _, c in found])], ["lang", "n", "features", "counts"])


def _clustered(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centroids of unit vectors; starts are far apart."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(1)
        sums = np.stack([vectors[own == c].sum(0) for c in range(len(centroids))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def _radii(members: list[tuple[np.ndarray, np.ndarray]], model: Centroids, centroids: np.ndarray) -> np.ndarray:
    """The radius of each centroid at each level, from members (features, counts) of one language and parts of them."""
    rng = np.random.default_rng(0)
    cosines: list[list[list[float]]] = [[[] for _ in range(LEVELS)] for _ in centroids]
    for features, counts in members:
        own = int((centroids[:, features] @ model.vector(features, counts)).argmax())
        drawn = np.argsort(rng.exponential(size=len(features)) / counts)  # frequent ones first, as in a part of the text
        for level in range(len(features).bit_length()):
            part = drawn[: 1 << level]
            cosines[own][level].append(float(model.vector(features[part], np.ones(len(part))) @ centroids[own, features[part]]))
        cosines[own][level].append(float(model.vector(features, counts) @ centroids[own, features]))
    radius = np.zeros((len(centroids), LEVELS))
    for level in range(LEVELS):
        together = [x for own in cosines for x in own[level]]
        for c, own in enumerate(cosines):
            if held := own[level] if len(own[level]) >= MEMBERS else together:
                radius[c, level] = SLACK * np.quantile(held, LOW)
    return np.maximum.accumulate(radius, 1)


def fit(training: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Centroids:
    """Centroids learned from training (text, lang); rows without text or lang are left out. Equal input gives equal centroids."""
    known = training.where("lang is not null and text is not null").select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    df = np.ones(FEATURES + 1)
    for r in known.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] += r["n"]
    idf = np.log((df[-1] + 1) / df[:-1]) + 1
    model = Centroids(sorted(sizes), np.zeros((FEATURES, 0), np.float32), np.zeros(0, np.int64), np.zeros((0, LEVELS)), idf)
    if not sizes:
        return model
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)
    # copies are drawn together: they come once, and count COPIES times at most
    distinct = known.where(drawn).groupBy("lang", "text").agg(F.least(F.count(F.lit(1)), F.lit(COPIES)).alias("n"))
    rows = distinct.mapInArrow(_featured, "lang string, n long, features binary, counts binary").collect()  # about `sample` a language
    rows = [r for r in rows for _ in range(r["n"])]
    rows.sort(key=lambda r: (r["lang"], bytes(r["features"]), bytes(r["counts"])))
    weights, language, radius = [], [], []
    for i, lang in enumerate(model.languages):
        own = [r for r in rows if r["lang"] == lang and len(r["features"])]
        if not own:
            continue
        members = [(np.frombuffer(r["features"], "<u2"), np.frombuffer(r["counts"], "<i4")) for r in own]
        vectors = np.zeros((len(own), FEATURES), np.float32)
        for row, (held, counts) in zip(vectors, members):
            row[held] = model.vector(held, counts)
        found = _clustered(vectors, centroids, ROUNDS)
        weights.append(found.T)
        language += [i] * len(found)
        radius.append(_radii(members, model, found))
    if weights:
        model.weights, model.language, model.radius = np.ascontiguousarray(np.concatenate(weights, 1)), np.array(language), np.concatenate(radius)
    return model


def predict(docs: DataFrame, model: Centroids, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score (cosine, 0 to 1) and rejected, from the text alone.

    A text that is null or without letters is `und`, with score 0, and rejected. So is every text if nothing was
    learned. Each row gives one row; an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        for part in small_batches(batches, "__text", 2 << 20):
            found = [fitted.nearest(f, c) if ok else (None, 0.0, True) for ok, (f, c) in zip(part["__lettered"].to_pylist(), _trigram_counts(part["__text"]))]
            langs = pa.array([lang or UNKNOWN for lang, _, _ in found], pa.string())
            yield pa.record_batch(
                [*(part[c] for c in keep), langs, pa.array([s for _, s, _ in found], pa.float64()), pa.array([r for _, _, r in found], pa.bool_())],
                [*keep, "lang_pred", "score", "rejected"],
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, rejected boolean"
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*keep, F.col("text").alias("__text"), lettered.alias("__lettered")).mapInArrow(run, schema)


def remainder(column: str, divisor: int):
    """crc32 of an id as text, modulo divisor; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor
