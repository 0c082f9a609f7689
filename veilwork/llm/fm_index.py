"""An FM-index over word sequences: backward search through wavelet-tree ranks, sampled positions.

The text is many runs of words; symbol 0 ends each run. Suffixes are sorted as if every run's end were
a different symbol, smaller than all words and ordered by place, so no comparison leaves a run. Ranks
come from a wavelet matrix (a levelwise wavelet tree) of packed bits with block counts. Suffix
positions are sampled at each run's begin and at every SAMPLE-th place; a match walks back to the
nearest sample. All queries work on whole arrays of patterns.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class Bits:
    """A bit vector with ranks: ones before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros((n >> 6) + 2, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        block, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << low) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """Ranks of any symbol, and the symbol at a place, in one descent of the levels."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.shifts = list(range(max(1, int(size - 1).bit_length()) - 1, -1, -1))
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            one = (symbols >> shift) & 1 != 0
            self.levels.append(Bits(one))
            self.zeros.append(int(len(symbols) - one.sum()))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def descend(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Where the places come to lie among the sorted symbols, following the bits of each symbol."""
        out = list(places)
        for shift, bits, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            one = (symbol >> shift) & 1 != 0
            for k, at in enumerate(out):
                ones = bits.rank(at)
                out[k] = np.where(one, zeros + ones, at - ones)
        return out

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, where the place comes to lie)."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.get(at), bits.rank(at)
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence that ends with 0, sorted by prefix doubling; only ties are sorted again."""
    n = len(symbols)
    stops = np.flatnonzero(symbols == 0)
    first = symbols.astype(np.int64) + len(stops)
    first[stops] = np.arange(len(stops))
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    step = 1
    while True:
        alone = head & np.append(head[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        suffix = order[tied]
        key = group[tied] * n + rank[suffix + step]
        again = np.argsort(key, kind="stable")
        key, order[tied] = key[again], suffix[again]
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        head[tied] = new
        group[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[order[tied]] = group[tied]
        step *= 2


class FMIndex:
    """symbols: words 1..size - 1 in runs, each run ended by 0."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.wavelet = Wavelet(symbols[order - 1], size)
        self.first = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=size), out=self.first[1:])
        begin = np.ones(self.n, bool)
        begin[1:] = symbols[:-1] == 0
        begin |= np.arange(self.n) % SAMPLE == 0
        sampled = begin[order]
        self.sampled, self.places = Bits(sampled), order[sampled]

    def _extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zero, low, high = self.wavelet.descend(symbol, np.zeros(len(symbol), np.int64), low, high)
        return self.first[symbol] + low - zero, self.first[symbol] + high - zero

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns; each row holds its pattern at its right end."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        width = patterns.shape[1]
        for k in range(width):
            live = live[(lengths[live] > k) & (high[live] > low[live])]
            if not len(live):
                break
            low[live], high[live] = self._extend(patterns[live, width - 1 - k], low[live], high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the given suffixes."""
        out, walked = np.empty(len(rows), np.int64), 0
        left, at = np.arange(len(rows)), rows
        while len(left):
            there = self.sampled.get(at)
            out[left[there]] = self.places[self.sampled.rank(at[there])] + walked
            left, at = left[~there], at[~there]
            if len(left):
                symbol, down = self.wavelet.access(at)
                zero = self.wavelet.descend(symbol, np.zeros(len(symbol), np.int64))[0]
                at, walked = self.first[symbol] + down - zero, walked + 1
        return out
