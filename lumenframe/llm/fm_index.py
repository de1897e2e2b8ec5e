"""A compressed FM-index of many short strings: packed bits of a wavelet matrix, and a sample of the suffixes' places."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Every so many positions of a string keep their place; others are found from there.
SAMPLED = 8


class Bits:
    """Packed bits with ranks."""

    def __init__(self, bit: np.ndarray):
        packed = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
        packed[: len(bit)] = bit
        self.words = np.packbits(packed, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    """Symbols of a sequence of integers below 2 ** levels, and ranks of symbols in it."""

    def __init__(self, sequence: np.ndarray, levels: int):
        self.levels, self.rows = levels, []
        for level in range(levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.rows.append((Bits(bit), len(sequence) - int(bit.sum())))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def descend(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends among its equals of ``symbol`` at the last level."""
        for row, (bits, zeros) in enumerate(self.rows):
            ones = bits.ones(at)
            at = np.where((symbol >> (self.levels - 1 - row)) & 1, zeros + ones, at - ones)
        return at

    def follow(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and where it comes at the last level."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in self.rows:
            one, ones = bits.at(at), bits.ones(at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = symbol * 2 + one
        return symbol, at


def sorted_suffixes(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling, each up to the end of its string, equal ones by place. left: symbols before that end."""
    n, step = len(text), 1
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], text[order][1:] != text[order][:-1]]))
    longest = int(left.max()) if n else 0
    while step <= longest and rank[order[-1]] < n:
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:]
        following[left < step] = 0
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        step *= 2
    return order


class FmIndex:
    """Of strings of symbols from 1 on, string after string; first: where each begins, and the end of the last.

    The order of suffixes is used to build it and not kept: what stays are the transform's bits, its symbols' counts and every
    ``SAMPLED``-th place."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray):
        size = np.diff(first)
        strings = np.arange(len(size))
        owner = np.repeat(strings, size)
        text = np.zeros(len(symbols) + len(size), np.int64)  # a 0 ends each string
        text[np.arange(len(symbols)) + owner] = symbols
        self.begin = first[:-1] + strings
        left = np.repeat(self.begin + size, size + 1) - np.arange(len(text))
        array = sorted_suffixes(text, left)
        top = int(text.max()) if len(text) else 0
        self.n = len(text)
        self.matrix = WaveletMatrix(text[array - 1], max(1, top.bit_length()))
        counts = np.bincount(text, minlength=top + 1)
        self.first = np.cumsum(counts) - counts
        self.origin = self.matrix.descend(np.zeros(top + 1, np.int64), np.arange(top + 1))
        sampled = np.arange(len(text)) % SAMPLED == 0
        sampled[self.begin] = True
        marked = sampled[array]
        self.marks, self.places = Bits(marked), array[marked].astype(np.int32 if len(text) < 2**31 else np.int64)

    def search(self, patterns: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of many patterns at once; patterns: symbols of all of them, from the last to the first."""
        low = high = None
        for symbol in patterns:
            if low is None:
                low, high = np.zeros(len(symbol), np.int64), np.full(len(symbol), self.n)
            base = self.first[symbol] - self.origin[symbol]
            low, high = base + self.matrix.descend(low, symbol), base + self.matrix.descend(high, symbol)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The string that each row of an interval lies in: back through the transform to a sampled place."""
        out = np.zeros(len(rows), np.int64)
        active, steps = np.arange(len(rows)), 0
        while len(active):
            known = self.marks.at(rows)
            out[active[known]] = self.places[self.marks.ones(rows[known])] + steps
            active, rows = active[~known], rows[~known]
            symbol, at = self.matrix.follow(rows)
            rows = self.first[symbol] + at - self.origin[symbol]
            steps += 1
        return np.searchsorted(self.begin, out, "right") - 1
