"""Byte-level BPE of whole texts, one distinct pre-token at a time.

The vocabulary's pre-tokeniser cuts a text into pieces that are merged independently of each other, so a piece met
again needs no second encoding. Worker processes keep a bounded memo of pieces. Texts of Latin-1 characters take
this way (their classes are spelled out below and tested against the library); all others, and texts that hold an
added token's string, go whole to the library.
"""

from __future__ import annotations

import re

import numpy as np

#: Letters, digits and white space among the code points 0-255, as Unicode has them.
_L = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
_S = rb"\t-\r \x85\xa0"
#: Fixed pattern of the byte-level pre-tokeniser, for Latin-1 bytes.
PIECES = re.compile(
    rb"'s|'t|'re|'ve|'m|'ll|'d| ?[" + _L + rb"]+| ?[" + _N + rb"]+| ?[^" + _S + _L + _N + rb"]+|[" + _S + rb"]+(?![^" + _S + rb"])|[" + _S + rb"]+"
)
MEMO_LIMIT = 700_000
MEMO_LENGTH = 32
EMPTY = b""


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def latin_bytes(text: str, added: tuple[str, ...]) -> bytes | None:
    """The text as Latin-1 bytes, or None where it has to go to the library whole."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    for token in added:
        if token in text:
            return None
    return raw


class PieceMemo(dict):
    """Piece -> its ids as little-endian unsigned 32-bit bytes; encode_piece gives what is missing."""

    def __init__(self, encode_piece):
        super().__init__()
        self._encode_piece = encode_piece

    def __missing__(self, piece: bytes) -> bytes:
        ids = self._encode_piece(piece)
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_LIMIT:
                self.clear()
            self[piece] = ids
        return ids

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The pieces' ids, in order."""
        return list(map(self.__getitem__, pieces))


def as_u32(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class LibraryBpe:
    """Ids as the tokenizers library gives them for a vocabulary file, special strings in texts handled as its default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.memo = PieceMemo(self._piece)
        self.model, self.shown = self.tokenizer.model, dict(enumerate(byte_alphabet()))

    def _piece(self, piece: bytes) -> bytes:
        """The library's merges of a pre-token, in its byte alphabet."""
        shown = piece.decode("latin-1").encode().decode("latin-1").translate(self.shown)
        return as_u32([t.id for t in self.model.tokenize(shown)])

    def encode(self, text: str | None) -> bytes:
        """All ids of a text (None: empty) as little-endian unsigned 32-bit bytes."""
        if not text:
            return EMPTY
        raw = latin_bytes(text, self.added)
        if raw is None:
            return as_u32(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return EMPTY.join(self.memo.ids_of(PIECES.findall(raw)))

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """For each pre-token of a text: its first code point, and how many ids it has."""
        raw = latin_bytes(text, self.added)
        if raw is None:
            found = self.tokenizer.encode(text, add_special_tokens=False)
            return self._word_starts(found)
        parts = PIECES.findall(raw)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        counts = np.fromiter(map(len, self.memo.ids_of(parts)), np.int64, len(parts)) // 4
        return np.cumsum(lengths) - lengths, counts

    @staticmethod
    def _word_starts(found) -> tuple[np.ndarray, np.ndarray]:
        words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        offsets = np.array([o[0] for o in found.offsets], np.int64)
        if not len(words):
            return offsets, offsets
        first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (words[1:] < 0)]))
        return offsets[first], np.diff(np.append(first, len(words)))


_LOADED: dict[str, LibraryBpe] = {}


def library_bpe(path: str) -> LibraryBpe:
    """One encoder a worker process and vocabulary, kept between tasks."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = LibraryBpe(path)
    return _LOADED[path]
