"""An FM-index over a sequence of integer symbols, searched in bulk.

Holds the Burrows-Wheeler transform of the sequence in a wavelet tree
(matrix form, one bit level per array), and the suffix positions that are
multiples of a sampling step. All queries run on arrays of patterns.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        follow = np.zeros(n, np.int64)
        if width < n:
            follow[:n - width] = rank[width:] + 1
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(in_order[1:] != in_order[:-1], out=step[1:])
        rank[order] = step
        if step[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Index of ``symbols`` (integers from 1); a unique end 0 is added."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        text = np.append(np.asarray(symbols, np.int64), 0)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.size = len(text)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text))])
        kept = order % sample == 0
        self.sampled = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = self.bwt
        for bit in reversed(range(max(1, int(text.max()).bit_length()))):
            ones = (row >> bit) & 1 == 1
            zeros_before = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((bit, zeros_before, int(zeros_before[-1])))
            row = np.concatenate([row[~ones], row[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first ``i`` places of the BWT."""
        lo, hi = np.zeros_like(i), i
        for bit, zeros, n_zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            z_lo, z_hi = zeros[lo], zeros[hi]
            lo = np.where(one, n_zeros + lo - z_lo, z_lo)
            hi = np.where(one, n_zeros + hi - z_hi, z_hi)
        return hi - lo

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern (rows, padded at
        the right), by backward search; empty where it does not occur."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1 if len(patterns) else 1):
            alive = alive[(lengths[alive] >= back)]
            if not len(alive):
                break
            symbol = patterns[alive, lengths[alive] - back]
            known = symbol < len(self.below) - 1
            hi[alive[~known]] = lo[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            start = self.below[symbol]
            lo[alive] = start + self.rank(symbol, lo[alive])
            hi[alive] = start + self.rank(symbol, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        left, row, steps = np.arange(len(rows)), np.asarray(rows, np.int64), 0
        while len(left):
            here = self.sampled[row + 1] > self.sampled[row]
            out[left[here]] = self.positions[self.sampled[row[here]]] + steps
            left, row = left[~here], row[~here]
            symbol = self.bwt[row]
            row = self.below[symbol] + self.rank(symbol, row)
            steps += 1
        return out
