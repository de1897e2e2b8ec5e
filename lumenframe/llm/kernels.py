"""Vectorised numpy kernels over the UTF-8 buffers of Arrow string columns.

A kernel works on a *slice*: some whole texts of a batch, about ``SLICE_BYTES`` of them (or one longer
text), so its arrays stay small however the batches are cut. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

U64 = np.uint64
_GOLD, _MUL1, _MUL2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=U64)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is true inside the given inclusive byte ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but ASCII white space: [^\x20\x09-\x0D].
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, letters and every non-ASCII character: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit words."""
    x = (x ^ (x >> U64(30))) * _MUL1
    x = (x ^ (x >> U64(27))) * _MUL2
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts in them (one entry more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunks at all
        column = pa.array([], pa.large_string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes, or of one text."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice of a batch."""
    data, offsets = utf8(batch.column(column))
    for low, high in slices(offsets):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes that ``inside`` holds true, within texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    member = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = member[:-1], member[1:]
    starts = np.flatnonzero(member & (~before | edge[:-1]))
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each position, as little-endian words; past the end they are zero."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def head_bytes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The eight bytes from each start on, as a word; also of a text's neighbours, so mask them by length."""
    return _loads(data)[starts]


def low_bytes(n: int) -> np.uint64:
    """A mask of the first n bytes of such a word."""
    return _MASKS[n]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, never 0 or 1 (callers use these as separators)."""
    words, length = _loads(data), (ends - starts).astype(np.int64)
    out = mix((length.astype(U64) + U64(seed << 40)) * _GOLD)
    active, at, left = np.arange(len(starts)), starts.astype(np.int64), length
    while len(active):
        more = left > 0
        active, at, left = active[more], at[more], left[more]
        out[active] = mix(out[active] ^ (words[at] & _MASKS[np.minimum(left, 8)]))
        at, left = at + 8, left - 8
    out[out < U64(2)] += U64(2)
    return out


def _seed(k: int) -> np.uint64:
    return U64(k * int(_GOLD) & (1 << 64) - 1)


def gram_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k symbols from each position on; there are ``len(symbols) - k + 1`` of them."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, _seed(k))
    for j in range(k):
        out = mix(out + symbols[j : j + n])
    return out


def byte_gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """As gram_hash, of k bytes; k is a multiple of 8."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    words, out = _loads(data), np.full(n, _seed(k))
    for j in range(0, k, 8):
        out = mix(out + words[j : j + n])
    return out


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the smallest value (the rightmost of equals) in each window of ``width``."""
    best, where, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        take = right <= left
        where = np.where(take, where[step:], where[: len(where) - step])
        best = np.where(take, right, left)
        have += step
    return where


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, one after another."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def runs_of(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the runs of equal numbers in ``x`` begin and end."""
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return begin.tolist(), np.append(begin[1:], len(x)).tolist() if len(x) else []


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after another, each followed by a space, and where each begins there (and the end)."""
    size = ends - starts + 1
    bound = np.concatenate([[0], np.cumsum(size)])
    out = np.append(data, np.uint8(0x20))[np.repeat(starts, size) + ranges(size)]
    out[bound[1:] - 1] = 0x20
    return out, bound


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def cover(length: int, starts: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """Which of ``length`` positions lie in an interval."""
    delta = np.bincount(starts, minlength=length + 1).astype(np.int64)
    delta -= np.bincount(np.minimum(starts + widths, length), minlength=length + 1)
    return np.cumsum(delta)[:length] > 0
