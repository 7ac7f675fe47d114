"""Words of many texts at once, as arrays.

The texts of a batch lie one after another in one byte array, each followed by a space. UTF-8 keeps the bytes of ASCII
characters out of all others, so classes of ASCII characters can be looked up byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower.
ALNUM = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _keys(low: int, high: int) -> np.ndarray:
    """Random multipliers of the places from low to high in a word."""
    return mixed(np.arange(low + 1, high + 1, dtype=np.uint64) * _BASE)


_KEYS = _keys(0, _PIECE)
#: A random number for each byte.
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty), each with a space after it; where each text starts, and the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    texts = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(texts) else data, offsets - offsets[0]


@dataclass
class Words:
    """start, end: byte positions of each word; first: index of each text's first word, and of the end; text: where texts start."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    text: np.ndarray


def words_of(texts: pa.Array, kind: np.ndarray) -> Words:
    """Lower-cased (A-Z) words of all texts, by the bytes of their kind, with a 64-bit hash of each."""
    data, offsets = joined(texts)
    data = LOWER[data]
    inside = kind[data].view(np.int8)
    if not len(data):
        nothing = np.zeros(0, np.int64)
        return Words(nothing, nothing, np.zeros(len(offsets), np.int64), nothing.astype(np.uint64), offsets)
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        change = np.concatenate([[0], change])
    start, end = change[::2], change[1::2]  # the last byte is a space, so every word ends
    return Words(start, end, np.searchsorted(start, offsets), _hashes(data, start, end), offsets)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Multilinear hash of each word: its bytes' numbers times those of their places; in pieces, to stay in the cache."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        low = start[i]
        j = int(np.searchsorted(end, low + _PIECE, "right"))
        if j == i:  # one word longer than a piece
            out[i] = _long_hash(data[low : end[i]])
            i += 1
            continue
        part, a = data[low : end[j - 1]], start[i:j] - low
        place = np.arange(len(part)) - np.repeat(a, np.diff(np.append(a, len(part))))
        edges = np.stack([a, end[i:j] - low], 1).ravel()[:-1]  # words and gaps in turn
        out[i:j] = np.add.reduceat(_VALUES[part] * _KEYS[place], edges)[::2]
        i = j
    return mixed(out + (end - start).astype(np.uint64) * _BASE)


def _long_hash(word: np.ndarray) -> np.uint64:
    total = np.uint64(0)
    for low in range(0, len(word), _PIECE):
        part = word[low : low + _PIECE]
        total = np.sum(np.append(_VALUES[part] * _keys(low, low + len(part)), total), dtype=np.uint64)
    return total


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = total * _BASE + words[i : len(words) - n + 1 + i]
    return mixed(total)
