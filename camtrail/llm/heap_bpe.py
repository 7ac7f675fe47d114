"""BPE encoding with a queue of merges, and decoding (operator 10).

A pre-token is a doubly linked list of symbols. Every adjacent pair that the vocabulary can merge waits in a priority
queue by rank, then position. The best is merged, its neighbours' new pairs join the queue, and entries whose symbols
have changed meanwhile are skipped as stale. Decoding concatenates the ids' vocabulary strings.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from camtrail.llm.bpe_words import EMPTY, PIECES, PieceMemo, as_u32, byte_alphabet, latin_bytes
from camtrail.llm.tables import small_batches


class HeapBpe:
    """Encoder and decoder of a byte-level vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, alphabet = spec["model"]["vocab"], byte_alphabet()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.byte_ids = [vocabulary[c] for c in alphabet]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        byte_of = {c: bytes([b]) for b, c in enumerate(alphabet)}
        strings = vocabulary | self.added
        self.strings = [b""] * (max(strings.values()) + 1)
        for token, i in strings.items():
            self.strings[i] = b"".join(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.memo = PieceMemo(lambda piece: as_u32(self.merge(piece.decode("latin-1").encode())))
        self.byte_of = byte_of
        self._path, self._pre = path, None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        merges, ids = self.merges, [self.byte_ids[b] for b in piece]
        n = len(ids)
        queue = [(*found, i) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        if not queue:
            return ids
        queue = [(rank, i, merged, ids[i], ids[i + 1]) for rank, merged, i in queue]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, merged, left, right = heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: a symbol of the pair has been merged since
            ids[i], ids[j] = merged, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if found := merges.get((merged, ids[j])):
                    heappush(queue, (found[0], i, found[1], merged, ids[j]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], merged))):
                heappush(queue, (found[0], h, found[1], ids[h], merged))
        return [x for x in ids if x >= 0]

    def _other_pieces(self, text: str) -> list[bytes]:
        """Pre-tokens of a text beyond Latin-1, by the vocabulary's own rule."""
        if self._pre is None:
            from tokenizers import Tokenizer

            self._pre = Tokenizer.from_file(self._path).pre_tokenizer
        return [b"".join(map(self.byte_of.__getitem__, piece)) for piece, _ in self._pre.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text (None: empty) as little-endian unsigned 32-bit bytes; added tokens' strings become their ids."""
        if not text:
            return EMPTY
        raw = latin_bytes(text, tuple(self.added))
        if raw is not None:
            return EMPTY.join(self.memo.ids_of(PIECES.findall(raw)))
        out = []
        for part in self.split_added.split(text) if self.split_added else [text]:
            if part in self.added:
                out.append(as_u32([self.added[part]]))
            elif (raw := latin_bytes(part, ())) is not None:
                out += self.memo.ids_of(PIECES.findall(raw))
            else:
                out += [as_u32(self.merge(piece)) for piece in self._other_pieces(part)]
        return EMPTY.join(out)

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids."""
        text = b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text.decode("utf-8", "replace").encode()


_LOADED: dict[str, HeapBpe] = {}


def heap_bpe(path: str) -> HeapBpe:
    """One encoder a worker process and vocabulary, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = HeapBpe(path)
    return _LOADED[path]


def _coded(model: str, passed: tuple[str, ...], digests: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = heap_bpe(model)
        for batch in small_batches(batches, "__text", 2 << 20):
            encoded = [bpe.encode(text) for text in batch["__text"].to_pylist()]
            counts = pa.array([len(x) // 4 for x in encoded], pa.int64())
            if digests:
                own = [pa.array([hashlib.sha256(x).hexdigest() for x in encoded]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in encoded])]
            else:
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in encoded])])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
                own = [ids, pa.array([bpe.decode(x).decode() for x in encoded])]
            names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
            yield pa.record_batch([*(batch[c] for c in passed), counts, *own], [*passed, "n_tokens", *names])

    return run


def encode_decode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """The kept columns of docs with n_tokens, ids (array of int) and decoded text, or with the digests of both.

    A null text counts as empty and gives no ids. Each row gives one row, repeated rows too; an empty table gives
    none. digests: ids_sha256 and decoded_sha256 (lowercase hex; of the ids as little-endian unsigned 32-bit
    integers, and of the UTF-8 bytes) in place of ids and decoded.
    """
    kept = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep)
    own = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(_coded(model, keep, digests), f"{kept}, n_tokens long, {own}")
