"""Word spans and word hashes of whole Arrow text columns, by numpy.

The operators that need words of every text share these helpers. They work
on the UTF-8 bytes of a column at once (all separators are ASCII, so byte
positions are safe) and go through long columns in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text forms a piece of its own.
PIECE = 1 << 21
#: Bytes hashed at once inside a piece.
_CHUNK = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def _table() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20240229))
    t = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t[65:91] = t[97:123]      # A-Z count as a-z
    return t


_BYTE = _table()
_POWERS: list[np.ndarray] = []


def blank_separated() -> np.ndarray:
    """Byte table of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def alphanumeric() -> np.ndarray:
    """Byte table of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
    A-Z became a-z: digits, ASCII letters and every non-ASCII character."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = True
    t[0x80:] = True
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _CHUNK + 1024)
        one = np.ones(1, np.uint64)
        _POWERS[:] = [np.cumprod(np.concatenate([one, np.full(size - 1, p, np.uint64)]))
                      for p in (_P, _P_INV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of rows ``i..j`` of a flat column.

    ``start``/``end``: byte positions within ``data``; ``first``: for each
    row the index of its first word, with one more entry at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, table: np.ndarray):
        self.base = int(offsets[i])
        self.data = data[self.base:int(offsets[j])]
        bounds = offsets[i:j + 1] - self.base
        n = len(self.data)
        word = table[self.data]
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        closes = word.copy()
        closes[:-1] &= ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < n)]
        opens[inner] = word[inner]
        closes[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.bounds = bounds

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, A-Z taken as a-z."""
        out = np.empty(len(self.start), np.uint64)
        k = 0
        while k < len(self.start):
            base = self.start[k]
            m = max(int(np.searchsorted(self.end, base + _CHUNK, "right")), k + 1)
            s, e = self.start[k:m] - base, self.end[k:m] - base
            n = int(e[-1])
            power, inverse = _powers(n + 1)
            acc = np.empty(n + 1, np.uint64)
            acc[0] = 0
            np.cumsum(_BYTE[self.data[base:base + n]] * power[:n], out=acc[1:])
            out[k:m] = (acc[e] - acc[s]) * inverse[s] + (e - s).astype(np.uint64)
            k = m
        return mix(out)


def batch_words(column, table: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """``(i, j, Words)`` for successive row ranges of an Arrow column."""
    data, offsets = flat(column)
    for i, j in pieces(offsets):
        yield i, j, Words(data, offsets, i, j, table)


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that ``Words.hashes`` gives for these words."""
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    everything = np.ones(256, bool)
    everything[0x20] = False
    return Words(data, np.array([0, len(data)]), 0, 1, everything).hashes()
