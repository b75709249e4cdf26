"""FM-index over a sequence of word numbers: wavelet matrix, backward search, sampled places."""

from __future__ import annotations

import numpy as np

# A suffix's place is stored at each so many words, and at the start of each piece.
SAMPLE = 8


def suffix_order(symbols: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Order of all suffixes; a break ends the comparison, as every break ranks on its own.

    Ranks are doubled in length until no two suffixes tie; since breaks differ, no tie is
    longer than a piece.
    """
    n = len(symbols)
    start = symbols.astype(np.int64) + n
    start[breaks] = np.arange(len(breaks))
    rank = np.unique(start, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ranked = rank[order]
        fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        if fresh.all():
            return order
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.append(first, n))
        tied = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(tied)
        members = order[at]
        after = members + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        group = np.repeat(first, sizes)[at]
        inner = np.lexsort((second, group))
        members, group, second = members[inner], group[inner], second[inner]
        order[at] = members
        # A new rank is the place of the first member of its subgroup.
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        heads = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        full = np.repeat(first, sizes)
        full[at] = heads
        rank = np.empty(n, np.int64)
        rank[order] = full
        step *= 2


class Wavelet:
    """Rank of a symbol before a place, one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        low = np.zeros_like(place)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            place = np.where(bit, zeros + ones[place], place - ones[place])
        return place - low

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[place + 1] - ones[place]
            out = 2 * out + bit
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
        return out


class FmIndex:
    """Index of pieces of word numbers (from 1), each followed by a break (0)."""

    def __init__(self, symbols: np.ndarray):
        symbols = np.append(symbols.astype(np.int64), 0) if not len(symbols) or symbols[-1] else symbols.astype(np.int64)
        self.size = len(symbols)
        breaks = np.flatnonzero(symbols == 0)
        order = suffix_order(symbols, breaks)
        self.wavelet = Wavelet(symbols[order - 1])
        counts = np.bincount(symbols, minlength=int(symbols.max()) + 2)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        sampled = np.zeros(self.size, bool)
        starts = np.concatenate(([0], breaks[:-1] + 1))
        lengths = np.diff(np.append(starts, self.size))
        sampled[(np.arange(self.size) - np.repeat(starts, lengths)) % SAMPLE == 0] = True
        self.marked = sampled[order]
        self.marks = np.concatenate(([0], np.cumsum(self.marked)))
        self.places = order[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase, read from its last word."""
        n = len(phrases)
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        open_ = np.arange(n)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[open_, k]
            known = symbol < len(self.first) - 2
            high[open_[~known]] = low[open_[~known]] = 0
            open_, symbol = open_[known], symbol[known]
            low[open_] = self.first[symbol] + self.wavelet.rank(symbol, low[open_])
            high[open_] = self.first[symbol] + self.wavelet.rank(symbol, high[open_])
            open_ = open_[high[open_] > low[open_]]
            if not len(open_):
                break
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the sequence of each row: steps back to the nearest stored place."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.marked[rows])
        while len(open_):
            symbol = self.wavelet.at(rows[open_])
            rows[open_] = self.first[symbol] + self.wavelet.rank(symbol, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.marked[rows[open_]]]
        return self.places[self.marks[rows]] + steps
