"""Plain restatements of what the operators return, for small inputs."""

from __future__ import annotations

import hashlib
import re


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def decontaminate(docs, items, window=13):
    """docs, items: lists of (id, text). (n_words, n_hit, ids) for each document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        own = words(text) if item is not None else []
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for _, text in docs:
        own, hit, ids = words(text), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if found := windows.get(tuple(own[i : i + size])):
                    hit.update(range(i, i + size))
                    ids |= found
        out.append((len(own), len(hit), sorted(ids)))
    return out


def repeated_bytes(docs, length=100):
    """docs: (doc_id, text) with ids that differ. (n_bytes, n_removed, n_spans, digest) for each."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                gone[i : i + length] = [True] * length
            seen.add(part)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g)))
    return [out[d] for d, _ in docs]


def linked(docs, n=4, threshold=85):
    """docs: (doc_id, text). (size of the set, smallest doc_id reachable) for each."""
    sets = []
    for _, text in docs:
        own = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set())
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        near = {j for x in s for j in holders.get(x, ())}
        for x in s:
            holders.setdefault(x, []).append(i)
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= threshold * (len(s) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least.setdefault(root(i), []).append(doc_id)
    return [(len(s), min(least[root(i)])) for i, s in enumerate(sets)]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def private(text):
    """(kind, start, end) of the base spans."""
    text, out = text or "", []
    count = lambda s: sum(c in "0123456789" for c in s)
    for k, (kind, pattern, holds) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= count(s) <= 19 and luhn(re.sub("[ -]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= count(s) <= 15),
    )):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if holds(m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]
