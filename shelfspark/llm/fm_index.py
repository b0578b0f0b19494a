"""FM-index over a sequence of numbers: wavelet matrix ranks, backward search, sampled suffix positions.

Symbol 0 is a break: no phrase holds it, and no occurrence goes over one. All queries take arrays, so a
step of the search is made for all phrases at once.
"""

from __future__ import annotations

import numpy as np

# Every how many-th position of the sequence keeps its place.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes that begin there. Breaks differ, the earlier one is smaller.

    Ranks by the first symbol are doubled to the first 2, 4, 8, ... symbols. Each round sorts only the
    suffixes that are still tied, so repeated passages cost further rounds for themselves alone.
    """
    n = len(symbols)
    breaks = symbols == 0
    first = symbols.astype(np.int64) + n
    first[breaks] = np.arange(int(breaks.sum()))
    order = np.argsort(first)
    keys = first[order]
    fresh = np.concatenate(([True], keys[1:] != keys[:-1])) if n else np.zeros(0, bool)
    starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else order
    rank = np.empty(n, np.int64)
    rank[order] = starts
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    width = 1
    while len(tied):
        at = order[tied]
        after = at + width
        keys = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        inner = np.argsort(keys)
        at, keys = at[inner], keys[inner]
        order[tied] = at
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        width *= 2
    return order


class BitRanks:
    """A row of bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones in the first ``at`` places."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)).astype(np.int64) & 1


class WaveletMatrix:
    """Ranks of the symbols of a sequence: one row of bits per bit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.levels = []
        for bit in reversed(range(max(1, int(kinds - 1).bit_length()))):
            ones = ((symbols >> bit) & 1).astype(bool)
            self.levels.append((bit, BitRanks(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        every = np.arange(kinds)
        self.origin = self._down(every, np.zeros(kinds, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbols >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first ``at`` places."""
        return self._down(symbols, at) - self.origin[symbols]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbols = np.zeros(len(at), np.int64)
        for bit, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            symbols |= one << bit
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at - self.origin[symbols]


class FMIndex:
    """Index of a sequence of symbols from 0 (break) up to ``kinds`` - 1."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        order = suffix_order(symbols)
        self.counts = np.bincount(symbols, minlength=kinds)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        # The symbol before each suffix; before the first one there is a break.
        self.ranks = WaveletMatrix(np.where(order > 0, symbols[order - 1], 0) if len(order) else symbols, kinds)
        begins = np.concatenate(([True], symbols[:-1] == 0)) if len(symbols) else np.zeros(0, bool)
        # Places at the start of a run are kept as well, so no walk crosses a break.
        kept = (order % SAMPLE == 0) | begins[order] if len(order) else begins
        self.kept, self.places = BitRanks(kept), order[kept]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the suffixes that begin with each phrase. ``phrases``: rows of symbols, filled up on the left."""
        last = phrases[:, -1]
        low, high = self.starts[last].copy(), self.starts[last + 1].copy()
        for step in range(2, phrases.shape[1] + 1):
            at = np.flatnonzero((low < high) & (lengths >= step))
            if not len(at):
                break
            symbols = phrases[at, -step]
            low[at] = self.starts[symbols] + self.ranks.rank(symbols, low[at])
            high[at] = self.starts[symbols] + self.ranks.rank(symbols, high[at])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows of the suffix order, by walking back to a kept place."""
        found, open_rows, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(open_rows):
            here = self.kept.get(at) == 1
            found[open_rows[here]] = self.places[self.kept.ones(at[here])] + steps
            open_rows, at = open_rows[~here], at[~here]
            symbols, before = self.ranks.symbol_and_rank(at)
            at = self.starts[symbols] + before
            steps += 1
        return found
