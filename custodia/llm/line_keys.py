"""Segment keys and sketches of lines, for all lines of a length at once.

Lines of one length have their segments and probes at the same places. Their
code points form a matrix, and one running sum along the rows gives the hash
of every substring: the sum of the mixed code points times powers of an odd
base (modulo 2**64), shifted back by its start.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Cells of one matrix of code points.
CELLS = 1 << 20
#: Bits of the sketch of letter pairs; an edit changes at most four of them.
PAIR_BITS = 64
PAIR_CHANGES = 4
LETTER_BITS = 56
LETTER_CHANGES = 2

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4096)
def places(n: int, edits: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(segments of a line of length ``n``, further substrings it probes
    with) as (number of the segment, start, size).

    A partner shorter by ``less`` has segments of ``size`` characters; the
    ones before the last start at a multiple of it, the last ends with the
    line. If segment i is whole, at most i edits lie before it or at most
    edits - i behind it, which bounds its shift from either side.
    """
    last, own_size = edits, n // (edits + 1)
    own = [(i, i * own_size, own_size) for i in range(last)] + [(last, n - own_size, own_size)]
    more = set()
    for less in range(edits + 1):
        size = (n - less) // (edits + 1)
        more.add((last, n - size, size))
        for i in range(last):
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                at = i * size + shift
                if 0 <= at <= n - size:
                    more.add((i, at, size))
    return own, sorted(more.difference(own))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def codes_of(lines: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).reshape(len(lines), n).astype(np.uint64)


def segment_hashes(codes: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, which of them are own segments): a row per line, a column per
    place."""
    m, n = codes.shape
    own, more = places(n, edits)
    sums = np.zeros((m, n + 1), np.uint64)
    np.cumsum(_mix(codes + np.uint64(1)) * _powers(_BASE, n), axis=1, dtype=np.uint64, out=sums[:, 1:])
    back = _powers(_INVERSE, n + 1)
    out = np.empty((m, len(own) + len(more)), np.uint64)
    for k, (i, at, size) in enumerate([*own, *more]):
        label = np.uint64((i << 40) + size + 1)
        out[:, k] = _mix((sums[:, at + size] - sums[:, at]) * back[at] + _mix(np.array([label], np.uint64)))
    return out.view(np.int64), np.arange(out.shape[1]) < len(own)


def _odd(where: np.ndarray, bits: int) -> np.ndarray:
    """Per row the bits that are hit an odd number of times, as bytes."""
    m = len(where)
    at = (np.arange(m, dtype=np.int64)[:, None] * bits + where.astype(np.int64)).ravel()
    odd = (np.bincount(at, minlength=m * bits) & 1).astype(np.uint8).reshape(m, bits)
    return np.packbits(odd, axis=1, bitorder="little")


def sketches(codes: np.ndarray) -> np.ndarray:
    """Per line two integers: the letters (by code modulo 56) that occur an
    odd number of times with the length modulo 128 above them, and 64 bits
    of the pairs of letters that do."""
    m, n = codes.shape
    letters = np.zeros((m, 8), np.uint8)
    letters[:, :7] = _odd(codes % np.uint64(LETTER_BITS), LETTER_BITS)
    letters[:, 7] = n & 127
    pairs = _mix((codes[:, :-1] << np.uint64(32)) + codes[:, 1:]) % np.uint64(PAIR_BITS)
    return np.concatenate([letters.view(np.int64), _odd(pairs, PAIR_BITS).view(np.int64)], axis=1)
