"""A compressed FM-index over word numbers, searched for many patterns at once.

The Burrows-Wheeler transform of the indexed sequences lies in a wavelet matrix: one packed bit vector per bit of a
symbol, with a running count of ones per 64-bit word.  Backward search keeps a range of sorted suffixes per pattern and
narrows it by one symbol at a time; the width of the range is the number of occurrences.  Suffixes are sorted by their
first ``DEPTH`` symbols, which is enough for patterns of up to that length.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64  # above a segment's length: its windows share a place of their minimizer
SEPARATOR = 1  # between sequences; 0 ends the text


class BitVector:
    """Packed bits with constant-time counts of ones."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """The number of ones before position i."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for bit in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> bit) & 1
            self.levels.append((bit, BitVector(bits.astype(bool))))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.start = self._down(np.arange(size), np.zeros(size, dtype=np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, vector in self.levels:
            ones = vector.ones(i)
            i = np.where((symbol >> bit) & 1 == 1, vector.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The number of times that symbol occurs before position i."""
        return self._down(symbol, i) - self.start[symbol]


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first DEPTH symbols, by prefix doubling."""
    n, length = len(text), 1
    order = np.argsort(text, kind="stable")
    while True:
        ordered = text[order] if length == 1 else key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if length >= DEPTH or rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:n - length] = rank[length:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        length *= 2


class FmIndex:
    def __init__(self, sequences: list[np.ndarray], size: int):
        """``sequences`` of symbols from 2 to ``size`` - 1."""
        parts = [x for s in sequences for x in (s, [SEPARATOR])]
        text = np.concatenate([*parts, [0]]).astype(np.int64)
        order = sorted_suffixes(text)
        self.size = len(text)
        self.matrix = WaveletMatrix(text[order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns with ``symbol`` put in front."""
        first = self.first[symbol]
        return first + self.matrix.rank(symbol, low), first + self.matrix.rank(symbol, high)


def repeated_windows(sequences: list[np.ndarray], queries: list[int], size: int, window: int) -> list[np.ndarray]:
    """For each query (a sequence's number), whether each of its windows occurs at least twice in all sequences.

    Matching statistics: from an end position the search goes backwards as long as the words still occur twice.  That
    settles every window within the matched words; the next end is the last one of a window that starts before them.
    """
    index = FmIndex(sequences, size)
    flat = np.concatenate(sequences)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    found = np.zeros(len(flat), dtype=bool)  # by window start
    base = starts[queries]
    end = starts[np.asarray(queries) + 1] - 1
    at = end.copy()  # the next word to put in front
    low, high = np.zeros(len(base), dtype=np.int64), np.full(len(base), index.size)
    live = np.flatnonzero(end - base + 1 >= window)
    while len(live):
        lo, hi = index.extend(flat[at[live]], low[live], high[live])
        still = hi - lo >= 2
        low[live], high[live] = lo, hi
        at[live[still]] -= 1
        over = live[~still | (at[live] < base[live])]
        for q in over:  # at[q] is the last word that did not match
            if end[q] - at[q] >= window:
                found[at[q] + 1:end[q] - window + 2] = True
            end[q] = min(end[q] - 1, at[q] + window - 1)
        at[over] = end[over]
        low[over], high[over] = 0, index.size
        live = live[(at[live] >= base[live]) & (end[live] - base[live] + 1 >= window)]
    return [found[starts[q]:starts[q + 1] - window + 1] for q in queries]
