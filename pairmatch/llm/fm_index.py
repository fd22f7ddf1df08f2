"""An FM-index over word numbers: wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many words the position of a suffix is stored.
SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes; 0 is a separator, and each one is a symbol of its own, by position.

    Suffixes are compared by prefixes of doubling length until all differ, which the separators
    bound by the longest run between them.
    """
    n = len(symbols)
    breaks = symbols == 0
    key = np.where(breaks, np.cumsum(breaks) - 1, symbols.astype(np.int64) + breaks.sum())
    order = np.argsort(key, kind="stable")
    length = 1
    while True:
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if n == 0 or new[order[-1]] == n - 1:
            return order
        later = np.full(n, -1, np.int64)
        later[:-length] = new[length:]
        key = new * (n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        length *= 2


class WaveletTree:
    """Ranks of symbols in a sequence, one level of bits after the other."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        rest = symbols
        for shift in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (rest >> shift) & 1 == 1
            zeros = np.concatenate(([0], np.cumsum(~ones))).astype(np.int32)
            self.levels.append((shift, zeros, int(zeros[-1])))
            rest = np.concatenate((rest[~ones], rest[ones]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start = np.zeros_like(end)
        for shift, zeros, total in self.levels:
            one = (symbol >> shift) & 1 == 1
            start, end = (
                np.where(one, total + at - zeros[at], zeros[at]) for at in (start, end)
            )
        return end - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before that."""
        start, symbol = np.zeros_like(at), np.zeros_like(at)
        for shift, zeros, total in self.levels:
            one = zeros[at + 1] == zeros[at]
            symbol |= one.astype(at.dtype) << shift
            start, at = (np.where(one, total + x - zeros[x], zeros[x]) for x in (start, at))
        return symbol, at - start


class FMIndex:
    """Counts and finds patterns of word numbers (1 and above) in a sequence with separators."""

    def __init__(self, symbols: np.ndarray, largest: int, sample: int = SAMPLE):
        symbols = np.append(symbols, 0).astype(np.int64)
        suffixes = suffix_array(symbols)
        self.size = len(symbols)
        self.tree = WaveletTree(symbols[suffixes - 1], largest)
        counts = np.bincount(symbols, minlength=largest + 1)
        self.smaller = np.concatenate(([0], np.cumsum(counts)))
        # a walk back never has to cross a separator: starts of runs are stored as well
        stored = (suffixes % sample == 0) | (symbols[suffixes - 1] == 0)
        self.stored = stored
        self.place = np.cumsum(stored) - 1
        self.positions = suffixes[stored]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each row of ``patterns``, from last to first word."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        for word in patterns.T[::-1]:
            low = self.smaller[word] + self.tree.rank(word, low)
            high = self.smaller[word] + self.tree.rank(word, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to the next stored one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while (open_ := np.flatnonzero(~self.stored[rows])).size:
            symbol, rank = self.tree.symbol_and_rank(rows[open_])
            rows[open_] = self.smaller[symbol] + rank
            steps[open_] += 1
        return self.positions[self.place[rows]] + steps
