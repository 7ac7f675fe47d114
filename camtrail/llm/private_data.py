"""Personal data in texts: patterns, and terms that reveal what the patterns protect (operator 5).

Patterns find e-mail and IP addresses, card and phone numbers; words of KEY_LENGTH or more bytes that mix letters and
digits are protected as keys. Entities are each such value, what it shares with others (mail domain and local part,
first digits or parts of numbers), and its kind as a whole. Terms are words and pairs of neighbouring words. For each term that stands near an entity the corpus tells
how strongly it reveals it: with document frequencies, P(e | t) against P(e), as the share of the entity's
log2(1 / P(e)) bits that the term gives away. Terms that give away DISCLOSED or more of some entity, and have it near
them in HALF or more of their documents, are generalised wherever they stand; evidence from fewer than SUPPORT different
texts does not count. Frequencies cover all documents.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camtrail.llm.decontaminate import Lookup
from camtrail.llm.storage import written
from camtrail.llm.tables import numbered, small_batches
from camtrail.llm.text_arrays import ALNUM, Words, joined, mixed, words_of

_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
KINDS = ("email", "ip", "card", "phone", "term", "key")
TERM, KEY = KINDS.index("term"), KINDS.index("key")
KEY_LENGTH = 20
NEAR = 8
SUPPORT = 3
DISCLOSED = 0.9
HALF = 0.5
#: So many terms are held by every worker at most; more are joined by a shuffle.
TERM_BLOCK = 1 << 20
#: Fixed patterns, written so that no text takes more than linear time: starts inside a run of the first class can
#: only match where the run's own start does, or at the end of a match.
_LOCAL = "[A-Za-z0-9._%+-]"
_MAIL = _LOCAL + r"++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
MAIL_HERE, MAIL_NEXT = re.compile(_MAIL), re.compile(f"(?<!{_LOCAL})" + _MAIL)
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile("[0-9@]")
_SEPARATORS = re.compile(r"[^0-9]")


def _mails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while found := MAIL_HERE.match(text, at) or MAIL_NEXT.search(text, at):
        yield found.span()
        at = found.end()


def _is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _passes_luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _is_card(text: str) -> bool:
    digits = _SEPARATORS.sub("", text)
    return 14 <= len(digits) <= 19 and _passes_luhn(digits)


def _is_phone(text: str) -> bool:
    return 10 <= len(_SEPARATORS.sub("", text)) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind as an index, end) in code points, ordered; failing matches are dropped, not retried."""
    if not text or not _ANY.search(text):
        return []
    found = [(a, 0, b) for a, b in _mails(text)] if "@" in text else []
    for kind, pattern, holds in ((1, IP, _is_ip), (2, CARD, _is_card), (3, PHONE, _is_phone)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if holds(m[0])]
    return sorted(found)


_KEY_BYTES = np.where(np.isin(np.arange(256), range(0x30, 0x3A)), 1, np.where(np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)]), 2, 4)).astype(np.uint8)


def key_words(texts: pa.Array, words: Words) -> np.ndarray:
    """Indexes of the words that are keys: long ones of ASCII letters and digits, with both."""
    data, _ = joined(texts)
    long = np.flatnonzero(words.end - words.start >= KEY_LENGTH)
    return np.array([i for i in long.tolist() if np.bitwise_or.reduce(_KEY_BYTES[data[words.start[i] : words.end[i]]]) == 3], np.int64)


def entities_of(value: str, kind: int) -> list[str]:
    """What a value tells: itself, what it shares with others, and its kind."""
    parts = [f"{KINDS[kind]}", f"{KINDS[kind]} {value}"]
    if kind == 0:
        local, _, domain = value.partition("@")
        parts += [f"local {local}", f"domain {domain}"]
    elif kind == 1:
        parts.append("net " + ".".join(value.split(".")[:2]))
    elif kind in (2, 3):
        parts.append(f"first {KINDS[kind]} {_SEPARATORS.sub('', value)[:6]}")
    return parts


def _byte_spans(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans as byte ranges."""
    found, at, offset = [], 0, 0
    for a, _, b in spans:
        offset += len(text[at:a].encode()) if a >= at else -len(text[a:at].encode())
        at = a
        found.append((offset, offset + len(text[a:b].encode())))
    return found


def _terms_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and of each word with the next (of a text's last word: with one of another text, or itself)."""
    return words.hash, mixed(words.hash * _PAIR + np.append(words.hash[1:], words.hash[-1:]))


def _terms_by_text(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every term, the index of its first word, and the index of its text."""
    single, pair = _terms_of(words)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = np.flatnonzero(text[1:] == text[:-1])
    at = np.concatenate([np.arange(len(single)), inside])
    return np.concatenate([single, pair[inside]]), at, text[at]


def _contexts(near: int):
    """The terms near each entity: term, entity, row_id, and a hash of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, "text"):
            words, met = words_of(part["text"], ALNUM), set()
            single, pair = _terms_of(words)
            data, _ = joined(part["text"])
            keys = key_words(part["text"], words)
            of = np.searchsorted(words.first, keys, "right") - 1
            texts, rows, same = part["text"].to_pylist(), part["row_id"].to_pylist(), {}
            ranges = [(i, KEY, data[words.start[k] : words.end[k]].tobytes().decode(), int(words.start[k]), int(words.end[k])) for k, i in zip(keys.tolist(), of.tolist())]
            for i, text in enumerate(texts):
                spans = base_spans(text)
                ranges += [(i, kind, text[a:b], int(words.text[i]) + x, int(words.text[i]) + y) for (a, kind, b), (x, y) in zip(spans, _byte_spans(text, spans))]
            for i, kind, value, a, b in ranges:
                if i not in same:
                    same[i] = _entity(texts[i])
                before, after = np.searchsorted(words.end, a, "right"), np.searchsorted(words.start, b)
                low, high = max(words.first[i], before - near), min(words.first[i + 1], after + near)
                sides = ((low, before), (after, high))
                terms = {t for x, y in sides for t in (*single[x:y].tolist(), *pair[x : max(x, y - 1)].tolist())}
                met.update((t, e, rows[i], same[i]) for e in map(_entity, entities_of(value.lower(), kind)) for t in terms)
            terms, entities, ids, texts = zip(*met) if met else ((), (), (), ())
            yield pa.record_batch([pa.array(np.array(terms, np.uint64).view(np.int64)), *(pa.array(x, pa.int64()) for x in (entities, ids, texts))], ["term", "entity", "row_id", "same"])

    return run


def _entity(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _all_document_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a batch each term is."""
    for part in small_batches(batches, "text"):
        terms, _, text = _terms_by_text(words_of(part["text"], ALNUM))
        term, place = np.unique(terms, return_inverse=True)
        counts = np.bincount(np.unique(text * max(1, len(term)) + place) % max(1, len(term)), minlength=len(term))
        yield pa.record_batch([pa.array(term.view(np.int64)), pa.array(counts)], ["term", "n_term"])


def _document_counts(held):
    """In how many documents each of the held terms is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = Lookup(held.value), np.zeros(len(held.value), np.int64)
        for part in small_batches(batches, "text"):
            terms, _, text = _terms_by_text(words_of(part["text"], ALNUM))
            at, term = lookup.find(terms)
            counts += np.bincount(np.unique(text[at] * len(counts) + term) % max(1, len(counts)), minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(held.value[found].view(np.int64)), pa.array(counts[found])], ["term", "n_term"])

    return run


def _held(terms: DataFrame) -> np.ndarray | None:
    """The terms sorted, 8 MB at most; None if there are more."""
    if terms.limit(TERM_BLOCK + 1).count() > TERM_BLOCK:
        return None
    return np.sort(np.array([r["term"] for r in terms.toLocalIterator()], np.int64).view(np.uint64))


def revealing_terms(rows: DataFrame, near: int = NEAR, support: int = SUPPORT, disclosed: float = DISCLOSED, half: float = HALF) -> DataFrame:
    """term (hash), entity (hash) and disclosure of the words and pairs of words of rows (row_id, text) that give away protected entities."""
    spark = rows.sparkSession
    marked = rows.where(F.col("text").rlike("[0-9@]")).select("row_id", "text")  # no entity is without a digit or @
    met = written(marked.mapInArrow(_contexts(near), "term long, entity long, row_id long, same long").distinct(), "met")
    entities = met.select("entity", "row_id").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # copies are no evidence of their own: distinct texts first, so that no group is gathered
    supported = met.select("term", "entity", "same").distinct().groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= support)
    both = met.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_both")).join(supported, ["term", "entity"])
    candidates = written(both, "candidates")
    terms = written(candidates.select("term").distinct(), "terms")
    held = _held(terms)
    if held is not None:
        counts = rows.select("text").mapInArrow(_document_counts(spark.sparkContext.broadcast(held)), "term long, n_term long")
    else:
        counts = rows.select("text").mapInArrow(_all_document_counts, "term long, n_term long").join(terms, "term", "left_semi")
    totals = counts.groupBy("term").agg(F.sum("n_term").alias("n_term"))
    n = rows.count()
    given, alone = F.col("n_both") / F.col("n_term"), F.col("n_entity") / F.lit(n)
    disclosure = F.log2(given / alone) / F.log2(1 / alone)
    told = candidates.join(totals, "term").join(entities, "entity").withColumn("disclosure", disclosure)
    return told.where((given >= half) & (F.col("disclosure") >= disclosed)).select("term", "entity", "disclosure")


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _term_spans(words: Words, data: np.ndarray, at: np.ndarray, size: np.ndarray, kind: int) -> dict[int, list[tuple[int, int, int]]]:
    """Terms that begin at some words (sorted), of one word or two, as spans of each text that has any, in one pass over it; those that overlap are one."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    text = np.searchsorted(words.first, at, "right") - 1
    cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]])) if len(at) else []
    for a, z in zip(cuts[:-1], cuts[1:]):
        i = int(text[a])
        base = int(words.text[i])
        start, end = words.start[at[a:z]] - base, np.maximum.accumulate(words.end[at[a:z] + size[a:z] - 1] - base)
        new = np.concatenate([[True], start[1:] >= end[:-1]])
        start, end = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, z - a - 1)]
        # code points before each byte: bytes that begin one
        points = np.concatenate([[0], np.cumsum((data[base : words.text[i + 1]] & 0xC0) != 0x80)])
        found[i] = [(x, kind, y) for x, y in zip(points[start].tolist(), points[end].tolist())]
    return found


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every term with its place: twice the index of its first word in its text, and one more for a pair."""
    for part in small_batches(batches, "text"):
        words = words_of(part["text"], ALNUM)
        terms, at, text = _terms_by_text(words)
        pair = np.arange(len(terms)) >= len(words.hash)
        yield pa.record_batch([pa.array(terms.view(np.int64)), pa.array(part["row_id"].to_numpy()[text]), pa.array(2 * (at - words.first[text]) + pair)], ["term", "row_id", "place"])


def _not_inside(spans: list[tuple[int, int, int]], own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that no one of own (ordered) covers."""
    starts, ends = [a for a, _, _ in own], list(accumulate((b for _, _, b in own), max))
    return [s for s in spans if not (n := bisect_right(starts, s[0])) or ends[n - 1] < s[2]]


def _marked(held, keep: tuple[str, ...], clean: bool):
    """The kept columns with the spans of each text, and the text without them. Terms are those held, or at the places listed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(held.value) if held is not None else None
        for part in small_batches(batches, "__text"):
            column, texts = part["__text"], part["__text"].to_pylist()
            words, (data, _) = words_of(column, ALNUM), joined(column)
            if lookup is not None:
                terms, at, _ = _terms_by_text(words)
                told = lookup.find(terms)[0]
                at, size = at[told], 1 + (told >= len(words.hash))
            else:
                told = np.array([2 * a + p for a, places in zip(words.first.tolist(), part["__places"].to_pylist()) for p in places or ()], np.int64)
                at, size = told // 2, 1 + told % 2
            order, keys = np.lexsort((size, at)), key_words(column, words)
            terms, keys = _term_spans(words, data, at[order], size[order], TERM), _term_spans(words, data, keys, np.ones(len(keys), np.int64), KEY)
            spans = []
            for i, text in enumerate(texts):
                own = base_spans(text)
                # a term inside a base span is covered by it
                spans.append(sorted(own + _not_inside([*terms.get(i, ()), *keys.get(i, ())], own)))
            columns = [*(part[c] for c in keep), pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in spans], _SPAN_TYPE)]
            if clean:
                columns.append(pa.array([cleaned(t, s) for t, s in zip(texts, spans)], pa.string()))
            yield pa.record_batch(columns, [*keep, "spans", *["clean_text"] * clean])

    return run


def cleaned(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, generalised to its kind."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), clean: bool = False, **thresholds) -> DataFrame:
    """The kept columns with spans (start, kind as an index of KINDS, end; code points, ordered), and clean_text if asked for.

    docs: text and the kept columns, read from files. A null text counts as empty and has no spans; its clean text is
    empty. Repeated rows give repeated results and count as one text of evidence; an empty table gives none.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = numbered(docs.select(text))
    revealing = written(revealing_terms(rows, **thresholds).select("term").distinct(), "revealing")
    told, kinds = _held(revealing), dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", spans {_SPANS}" + ", clean_text string" * clean
    if told is not None:
        return docs.select(*keep, text.alias("__text")).mapInArrow(_marked(spark.sparkContext.broadcast(told), keep, clean), schema)
    found = rows.mapInArrow(_places, "term long, row_id long, place long").join(revealing, "term")
    lists = found.groupBy("row_id").agg(F.collect_list("place").alias("__places"))  # no more than a text has terms
    held = numbered(docs.select(*keep, text.alias("__text")), "__row").join(lists.withColumnRenamed("row_id", "__row"), "__row", "left")
    return held.select(*keep, "__text", "__places").mapInArrow(_marked(None, keep, clean), schema)


def span_text(spans) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
