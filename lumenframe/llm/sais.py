"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Suffixes are classified (smaller or larger than the next one), leftmost-smaller substrings are sorted and named by comparison, the string
of names is sorted by the same function, and two scans over the buckets induce the order of all suffixes.

A scan is sequential in principle: what it places, it meets again further on. It is done in batches of buckets that place nothing
among themselves, so a batch is a few array operations; a bucket that does place suffixes in itself (a symbol that follows itself)
is done alone, in generations. Small alphabets have few buckets and large ones few suffixes in each, which land far away.
"""

from __future__ import annotations

import numpy as np

#: Slots looked at to find a batch: at first, and at least; afterwards twice as many as the last one had.
WINDOW = 256


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one (S-type); the end of the string is smallest."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])  # last positions of runs, but for the last run
    smaller = np.append(s[change] < s[change + 1], False)
    lengths = np.diff(np.concatenate([[0], change + 1, [n]]))
    return np.repeat(smaller, lengths)


class _Scan:
    """One scan from the smallest bucket up: seeds stand at the ends of their buckets, induced suffixes fill these from their heads."""

    def __init__(self, s: np.ndarray, size: int, wanted: np.ndarray, seeds: np.ndarray):
        self.s, self.size, self.wanted = s, size, wanted
        self.start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))])
        self.head = self.start[:-1].copy()
        self.slots = np.full(len(s), -1)
        symbols = s[seeds]
        each = np.bincount(symbols, minlength=size)
        self.tail = self.start[1:] - each
        self.slots[self.tail[symbols] + np.arange(len(seeds)) - (np.cumsum(each) - each)[symbols]] = seeds

    def push(self, at: np.ndarray, symbols: np.ndarray) -> None:
        """Places suffixes at the heads of their buckets, in order."""
        if len(at) == 1:
            place = self.head[symbols[0]]
            self.slots[place] = at[0]
            self.head[symbols[0]] = place + 1
        elif len(at):
            order = np.argsort(symbols, kind="stable")
            symbols = symbols[order]
            new = np.concatenate([[True], symbols[1:] != symbols[:-1]])
            begin = np.flatnonzero(new)
            place = self.head[symbols] + np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            self.slots[place] = at[order]
            last = np.append(begin[1:], len(at)) - 1
            self.head[symbols[last]] = place[last] + 1

    def induced(self, suffixes: np.ndarray) -> np.ndarray:
        """The wanted suffixes one place before the given ones."""
        before = suffixes[suffixes > 0] - 1
        return before[self.wanted[before]]

    def bucket(self, c: int) -> None:
        """A bucket with what its own members place in it, generation after generation, and then its seeds."""
        low = self.start[c]
        while low < self.head[c]:
            generation = self.slots[low : self.head[c]]
            low = self.head[c]
            before = self.induced(generation)
            self.push(before, self.s[before])
        before = self.induced(self.slots[self.tail[c] : self.start[c + 1]])
        self.push(before, self.s[before])

    def run(self) -> np.ndarray:
        s, start, size, window = self.s, self.start, self.size, WINDOW
        c = 0
        while c < size:
            top = max(c + 1, int(np.searchsorted(start, start[c] + window, "right")) - 1)
            part = self.slots[start[c] : start[top]]
            have = part[part >= 0]
            if not len(have):
                c = top
                continue
            ok = have > 0
            ok[ok] = self.wanted[have[ok] - 1]
            bucket = s[have]
            target = np.where(ok, s[have - 1], size)
            least = np.minimum.accumulate(target)
            clash = least <= bucket
            first = int(clash.argmax()) if clash.any() else len(have)
            end = min(int(least[max(first - 1, 0)]), int(bucket[first]) if first < len(have) else top)
            if end <= bucket[0]:
                self.bucket(int(bucket[0]))
                c = int(bucket[0]) + 1
                continue
            ok &= bucket < end
            self.push(have[ok] - 1, target[ok])
            window = max(WINDOW, 2 * int(start[end] - start[c]))
            c = end
        return self.slots


def _induce(s: np.ndarray, size: int, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix array that leftmost-S suffixes in the order of ``seeds`` induce."""
    up = _Scan(s, size, ~small, seeds)
    up.push(np.array([len(s) - 1]), s[-1:])  # what the end of the string induces comes first
    found = up.run()
    del up  # one scan's tables at a time
    found = found[found >= 0]
    found = found[~small[found]]  # the larger suffixes
    return _Scan(size - 1 - s, size, small, found[::-1]).run()[::-1]


def _names(s: np.ndarray, ordered: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rank of each leftmost-S substring, in sorted order; end: where the one at a position ends. Only equal ones share a rank."""
    a, b = ordered[:-1], ordered[1:]
    length = end[a] - a
    same = length == end[b] - b
    last = end.max()
    same &= (end[a] < last) & (end[b] < last)  # the last one ends with the string, like no other
    active = np.flatnonzero(same)
    step = 0
    while len(active):
        differs = s[a[active] + step] != s[b[active] + step]
        same[active[differs]] = False
        step += 1
        active = active[~differs & (length[active] > step)]
    return np.cumsum(np.concatenate([[0], ~same]))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of a string of non-negative integers; a suffix that is a prefix of another is smaller."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.int32, copy=False)
    size = int(s.max()) + 1
    small = _types(s)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(seeds) > 1:
        first = _induce(s, size, small, seeds[np.argsort(s[seeds], kind="stable")])
        is_seed = np.zeros(n, bool)
        is_seed[seeds] = True
        ordered = first[is_seed[first]]  # leftmost-S substrings in order
        end = np.zeros(n, np.int64)
        end[seeds] = np.append(seeds[1:] + 1, n)
        names = _names(s, ordered, end)
        if names[-1] + 1 == len(seeds):
            seeds = ordered
        else:
            name = np.zeros(n, np.int32)
            name[ordered] = names
            name = name[seeds]
            del first, is_seed, ordered, end, names
            seeds = seeds[suffix_array(name)]
    return _induce(s, size, small, seeds)


def permuted_lcp(s: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each position the length of the common prefix with the suffix before it in the array (0 for the first); symbols of 16 bits.

    Only where the symbols before the two suffixes differ is anything compared; elsewhere the value is one less than that
    of the position to the left.
    """
    n = len(s)
    before = np.full(n, -1)
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    ok = (at > 0) & (before > 0)
    reducible[ok] = s[at[ok] - 1] == s[before[ok] - 1]
    compare = np.flatnonzero(~reducible & (before >= 0))
    wide = np.concatenate([np.ascontiguousarray(s, dtype="<u2"), np.zeros(8, "<u2")]).view(np.uint8)
    loads = np.ndarray((n + 5,), "<u8", wide, 0, (2,))  # four symbols at once
    value = np.zeros(n, np.int64)
    x, y, active = compare.copy(), before[compare], compare
    while len(active):
        limit = np.minimum(4, n - np.maximum(x, y))
        differ = loads[x] ^ loads[y]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 4, np.bitwise_count(low - np.uint64(1)) // 16).astype(np.int64)
        value[active] += np.minimum(equal, limit)
        more = (equal >= 4) & (limit >= 4)
        x, y, active = x[more] + 4, y[more] + 4, active[more]
    fixed = np.where(reducible, -1, value + at)
    return np.maximum(np.maximum.accumulate(fixed) - at, 0)
