"""Passages that occur again anywhere in a corpus, found with an index for each shard of repeated text.

A window is ``length`` consecutive symbols (words or bytes) of one text. Its *key gram* is the gram of ``gram`` symbols in it
with the smallest hash; equal windows have equal key grams, and consecutive windows mostly share theirs, so a text is a
sequence of runs of windows with one key gram each. Shards are made by key gram, so all occurrences of a window meet in
one shard, and only runs whose key gram occurs elsewhere too are sent there at all:

1. every text's runs (key gram, text, places) are counted by key gram, with partial aggregation;
2. runs with a repeated key gram are joined back to their texts, which give the *segments*: the bytes of a run;
3. equal segments are merged (with how many there are, and the smallest id), so copies cost no more than one;
4. each shard of distinct segments is indexed - by the caller - and tells of each segment's windows what its occurrences are (a shard
   in which that is plain from the numbers of copies needs no index, nor a segment of bytes that is like no other around its key gram);
5. that is joined back to the runs, and to the texts.

Hashes of grams only bring together what may be equal; an index compares the segments' own bytes. Equal segments are known by 128 bits of
hash. A shard of more than ``SPLIT`` distinct segments - a frequent passage with ever new surroundings - is not indexed: its segments'
single windows are counted by 128 bits of hash, so no task holds such a shard. Joins on key grams and segments let no frequent key
gather in a task either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .work import Workspace, join_by_size, map_arrow, split_by_size, tasks

#: Distinct segments that an index of one shard may hold, and their bytes.
SPLIT = 20_000
SPLIT_BYTES = 8 << 20
#: Bytes of segments of words, and of bytes, in one task: so many that an index takes some 300 MB while it is built.
SHARD_BYTES = {True: 4 << 20, False: 3 << 19}
#: Ranges of a key gram's place in a window, in which segments of bytes are compared before they are indexed.
PIECES = 8
#: Bits of a place that hold a run's number of windows.
COUNT_BITS = 16
_LONG = T.LongType()
_LONGS = T.ArrayType(_LONG)


@dataclass(frozen=True)
class Scheme:
    """What a window is: its symbols, how many, and of how many a key gram is made."""

    words: bool
    length: int
    gram: int

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.length or self.length - self.gram >= 1 << COUNT_BITS:
            raise ValueError(f"a gram of {self.gram} doesn't suit windows of {self.length}")
        if not self.words and self.gram % 8:
            raise ValueError("a gram of bytes is a multiple of 8")

    @property
    def key(self) -> T.DataType:
        return _LONG if self.words else T.BinaryType()

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a slice: hashes of its symbols (or the bytes), the first one of each text (and their end), bytes to cut segments
        from, and where each symbol begins in these (and the end)."""
        if not self.words:
            return data, offsets, data, np.arange(len(data) + 1)
        starts, ends, text = kernels.spans(data, offsets, kernels.NON_SPACE)
        return kernels.span_hash(data, starts, ends), np.searchsorted(text, np.arange(len(offsets))), *kernels.joined(data, starts, ends)

    def begins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where each symbol of joined segments begins (and the end)."""
        if not self.words:
            return np.arange(len(data) + 1)
        return np.concatenate([[0], np.flatnonzero(data == 0x20) + 1])

    def undecided(self, shard: np.ndarray, n: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which segments an index must be asked for, by their shards, numbers of copies and bytes. Words: the smallest document of a segment is that of
        all its windows where no other segment is in the shard; bytes: all windows of a shard repeat where all its segments do, and
        the windows of a segment that is like no other one of its shard are its own."""
        group = np.unique(shard, return_inverse=True)[1]
        if self.words:
            return (np.bincount(group) > 1)[group]
        asked = (np.bincount(group, weights=n == 1) > 0)[group]
        if asked.any():
            some = np.concatenate([[0], np.cumsum(np.diff(bounds)[asked])])
            asked[asked] = self._alike(shard[asked], n[asked], data[np.repeat(asked, np.diff(bounds))], some)
        return asked

    def _alike(self, shard: np.ndarray, n: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which segments may share a window with another one, if one of the two has no copies. All windows of a segment hold its key gram at one
        place, the last one with that hash, and equal windows hold it equally far from their beginning. That distance lies in one of ``PIECES``
        ranges; in a range from a to b, equal windows have the a bytes before the gram and the length - gram - b bytes after it in common."""
        spare = self.length - self.gram
        grams = kernels.signed(self.grams(data))
        owner = np.repeat(np.arange(len(n)), np.diff(bounds))[: len(grams)]
        here = np.flatnonzero(grams == shard[owner])
        here = here[here + self.gram <= bounds[owner[here] + 1]]
        at = np.full(len(n), -1)
        np.maximum.at(at, owner[here], here)
        alike = at < 0  # can't be; such a segment is not left out
        step = -(-spare // PIECES) or 1
        for a in range(0, spare + 1, step):
            start, stop = at - a, at + self.length - min(spare, a + step)
            held = np.flatnonzero((at >= 0) & (start >= bounds[:-1]) & (stop <= bounds[1:]))
            same = np.unique(kernels.span_hash(data, start[held], stop[held]), return_inverse=True)[1]
            alike[held] |= ((np.bincount(same) > 1) & (np.bincount(same, weights=n[held] == 1) > 0))[same] if len(held) else False
        return alike

    def plain(self, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What the index would say of the windows of other segments."""
        return low if self.words else (n > 1).astype(np.int64)

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        return kernels.gram_hash(symbols, self.gram) if self.words else kernels.byte_gram_hash(symbols, self.gram)


def _runs(scheme: Scheme, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: its text, first window (a position in the slice), number of windows, and key gram."""
    n = len(symbols) - scheme.length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    grams = scheme.grams(symbols)
    key = kernels.window_argmin(grams, scheme.length - scheme.gram + 1)[:n]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = text[:n] == text[scheme.length - 1 :]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:n] != text[: n - 1])
    start = np.flatnonzero(new & valid)  # the valid windows of a text come first, so runs end with validity
    stop = np.append(np.flatnonzero(new), n)
    end = stop[np.searchsorted(stop, start, "right")]
    last_valid = first[text[start] + 1] - scheme.length + 1
    return text[start], start, np.minimum(end, last_valid) - start, grams[key[start]]


def _places(scheme: Scheme, docs: DataFrame) -> DataFrame:
    """(gram, key, places) of rows (key, text): a text's key grams, each with the runs that have it; a place packs a run's first
    window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernels.text_slices(batch):
                symbols, first, _, _ = scheme.symbols(data, offsets)
                text, start, count, gram = _runs(scheme, symbols, first)
                order = np.lexsort((gram, text))
                text, gram, place = text[order], gram[order], ((start - first[text]) << COUNT_BITS | count)[order]
                new, bounds = _groups(text, gram)
                keys = batch.column("key").slice(low, high - low).take(pa.array(text[new]))
                yield pa.RecordBatch.from_arrays([pa.array(kernels.signed(gram[new])), keys, pa.ListArray.from_arrays(bounds, pa.array(place))], ["gram", "key", "places"])

    return map_arrow(docs, run, T.StructType([T.StructField("gram", _LONG), T.StructField("key", scheme.key), T.StructField("places", _LONGS)]))


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where groups of equal rows begin in sorted columns, and that as offsets of lists."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    begin = np.flatnonzero(new)
    return begin, pa.array(np.append(begin, n), pa.int32())


def _segments(scheme: Scheme, docs: DataFrame) -> DataFrame:
    """(shard, h, g, key, at, symbols) of the runs listed in ``runs`` of rows (key, text, runs): a text's distinct segments, known by 128
    bits h and g, with all places of each, and their bytes (words each followed by a space)."""
    names = ["shard", "h", "g", "key", "at", "symbols"]
    types = [_LONG, _LONG, _LONG, scheme.key, _LONGS, T.BinaryType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernels.text_slices(batch):
                _, first, raw, begins = scheme.symbols(data, offsets)
                listed = batch.column("runs").slice(low, high - low)
                lengths = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                fields = listed.flatten()
                many = fields.field("places").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                place = fields.field("places").flatten().to_numpy()
                owner = np.repeat(np.repeat(np.arange(high - low), lengths), many)
                gram = np.repeat(fields.field("gram").to_numpy(), many)
                at, count = place >> COUNT_BITS, place & ((1 << COUNT_BITS) - 1)
                # a row whose text is not the one that was counted (ids that aren't unique) may have no such windows
                fits = at + count + scheme.length - 1 <= np.diff(first)[owner]
                owner, gram, at, count = (x[fits] for x in (owner, gram, at, count))
                start, stop = begins[first[owner] + at], begins[first[owner] + at + count + scheme.length - 1]
                h, g = kernels.span_hash(raw, start, stop), kernels.span_hash(raw, start, stop, 1)
                order = np.lexsort((g, h, gram, owner))
                owner, gram, h, g, at, start, stop = (x[order] for x in (owner, gram, h, g, at, start, stop))
                new, bounds = _groups(owner, gram, h, g)
                keys = batch.column("key").slice(low, high - low).take(pa.array(owner[new]))
                blob = raw.tobytes()
                blobs = pa.array([blob[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist(), strict=True)], pa.binary())
                longs = [pa.array(gram[new]), *(pa.array(kernels.signed(x[new])) for x in (h, g))]
                yield pa.RecordBatch.from_arrays([*longs, keys, pa.ListArray.from_arrays(bounds, pa.array(at)), blobs], names)

    return map_arrow(docs, run, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))


#: From the joined bytes of a task's segments, where each begins (and the end), its smallest key and how many there are: a value of
#: each window, in order.
Indexer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _joined(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of segments one after another, and where each begins (and the end)."""
    blobs = pa.concat_arrays([part.column("symbols").cast(pa.large_binary()) for part in parts])
    bounds = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(blobs.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _indexed(scheme: Scheme, distinct: DataFrame, index: Indexer) -> DataFrame:
    """(shard, h, g, texts, windows): what the index of a partition's shards says of each window of its segments."""
    names = ["shard", "h", "g", "texts"]
    schema = T.StructType([*(T.StructField(n, _LONG) for n in names), T.StructField("windows", _LONGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if len(batch)]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        low, n = (table.column(c).to_numpy() for c in ("low", "n"))
        data, bounds = _joined(parts)
        windows = np.diff(np.searchsorted(scheme.begins(data, bounds), bounds)) - scheme.length + 1
        value = np.repeat(scheme.plain(low, n), windows)
        asked = scheme.undecided(table.column("shard").to_numpy(), n, data, bounds)
        if asked.any():
            some = np.concatenate([[0], np.cumsum(np.diff(bounds)[asked])])
            value[np.repeat(asked, windows)] = index(data[np.repeat(asked, np.diff(bounds))], some, low[asked], n[asked])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(windows)]), pa.int32()), pa.array(value))
        yield from pa.Table.from_arrays([*(table.column(n) for n in names), lists], schema.names).to_batches(max_chunksize=4096)

    return map_arrow(distinct, run, schema)


def _single(scheme: Scheme, distinct: DataFrame) -> DataFrame:
    """(x, y, i, shard, h, g, texts, low, n) of every window of segments: 128 bits x and y of it, and its number in the segment."""
    names = ["x", "y", "i", "shard", "h", "g", "texts", "low", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 1024):
                batch = whole.slice(low, 1024)
                data, bounds = _joined([batch])
                begins = scheme.begins(data, bounds)
                first = np.searchsorted(begins, bounds)
                each = np.diff(first) - scheme.length + 1
                i, owner = kernels.ranges(each), np.repeat(np.arange(len(batch)), each)
                at = first[owner] + i
                start, stop = begins[at], begins[at + scheme.length]
                ids = [pa.array(kernels.signed(kernels.span_hash(data, start, stop, seed))) for seed in (2, 3)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(i), *(batch.column(c).take(pa.array(owner)) for c in names[3:])], names)

    return map_arrow(distinct, run, T.StructType([T.StructField(n, _LONG) for n in names]))


def _counted(scheme: Scheme, distinct: DataFrame, value: Callable[[F.Column, F.Column], F.Column], work: Workspace) -> DataFrame:
    """The same as _indexed for shards that no index should hold, by counting windows."""
    single = work.save(_single(scheme, distinct))
    both = single.groupBy("x", "y").agg(F.min("low").alias("all_low"), F.sum("n").alias("all_n"), F.count("*").alias("times")).where("times > 1")
    shared, alone = split_by_size(single, work.save(both), ["x", "y"], "times", single.count())
    columns = ["shard", "h", "g", "texts", "i"]
    rows = shared.select(*columns, value(F.col("all_low"), F.col("all_n")).alias("v")).unionAll(alone.select(*columns, value(F.col("low"), F.col("n")).alias("v")))
    windows = F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda w: w["v"])
    out = work.save(rows.groupBy("shard", "h", "g").agg(F.first("texts").alias("texts"), windows.alias("windows")))
    work.drop(single)
    return out


def repeated_windows(
    docs: DataFrame, scheme: Scheme, index: Indexer, value: Callable[[F.Column, F.Column], F.Column], said: Callable[[F.Column, F.Column], F.Column], work: Workspace, split: int | None = None
) -> DataFrame:
    """(key, found) for each key of (key, text) with windows that go: ``found`` lists structs of first windows ``at`` and ``hit``, a
    flag of each window from any of them.

    Words: keys are longs, and a key gram counts as repeated if two keys have it; bytes: keys are binary, and it counts if it occurs
    twice. The index, or ``value`` of the smallest key and the number of a window's occurrences, says a number of it; said(number, key)
    tells if it goes.
    """
    spark, across, shard = docs.sparkSession, scheme.words, SHARD_BYTES[scheme.words]
    low = F.min("key") if across else F.lit(0).cast("long")
    places = work.save(_places(scheme, docs))
    again = F.min("key") < F.max("key") if across else F.sum(F.size("places")) > 1
    grams = places.groupBy("gram").agg(F.count("*").alias("texts"), again.alias("again"))
    grams = work.save(grams.where("again").select("gram", "texts"))
    runs = join_by_size(places, grams, ["gram"], "texts", places.count()).select("key", F.struct("gram", "places").alias("run"))
    listed = work.save(runs.groupBy("key").agg(F.collect_list("run").alias("runs")))
    work.drop(places, grams)
    segments = work.save(_segments(scheme, docs.join(listed, "key")))
    work.drop(listed)
    same = segments.groupBy("shard", "h", "g")
    distinct = work.save(same.agg(low.alias("low"), F.sum(F.size("at")).alias("n"), F.count("*").alias("texts"), F.first("symbols").alias("symbols")))
    sizes = distinct.groupBy("shard").agg(F.count("*").alias("many"), F.sum(F.octet_length("symbols")).alias("bytes"))
    large = work.save(sizes.where((F.col("many") > (split or SPLIT)) | (F.col("bytes") > SPLIT_BYTES)).select("shard", "many"))
    size = distinct.agg(F.sum(F.octet_length("symbols"))).first()[0] or 0
    indexed = distinct
    if split_up := not large.isEmpty():
        beyond, indexed = split_by_size(distinct, large, ["shard"], "many", distinct.count())
    known = work.save(_indexed(scheme, indexed.repartition(tasks(spark, size, shard), "shard"), index))
    every = known.unionByName(_counted(scheme, beyond.drop("many"), value, work)) if split_up else known
    hits = join_by_size(segments.select("shard", "h", "g", "key", "at"), every, ["shard", "h", "g"], "texts", segments.count())
    hits = hits.select("key", "at", F.transform("windows", lambda v: said(v, F.col("key"))).alias("hit")).where(F.exists("hit", lambda h: h))
    found = work.save(hits.groupBy("key").agg(F.collect_list(F.struct("at", "hit")).alias("found")))
    work.drop(segments, distinct, large, known)
    return found


def joined_segments(symbols: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments in one string, with a 0 after each (symbols go up by one); which segment each position belongs to; and
    where the windows begin, in order."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    out = np.zeros(len(symbols) + len(size), np.uint16)
    out[np.arange(len(symbols)) + owner] = symbols.astype(np.uint16) + 1
    windows = size - length + 1
    first = bounds[:-1] + np.arange(len(size))
    return out, np.repeat(np.arange(len(size)), size + 1), np.repeat(first, windows) + kernels.ranges(windows)


def hit_symbols(found: pa.ListArray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols lie in a window that goes, text after text, and where each text's begin. found: of each text a list or null."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    count = lambda lists: lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    runs = found.flatten()
    owner = np.repeat(np.arange(len(found)), count(found))
    places, hits = runs.field("at"), runs.field("hit")
    many, windows = count(places), count(hits)
    goes = hits.flatten().to_numpy(zero_copy_only=False).astype(bool)
    begin = np.cumsum(windows) - windows  # of each run's flags
    run = np.repeat(np.arange(len(many)), many)
    each = windows[run]
    start = np.repeat(first[owner[run]] + places.flatten().to_numpy(), each)
    step = kernels.ranges(each)
    window, goes = start + step, goes[np.repeat(begin[run], each) + step]
    inside = window + length <= np.repeat(first[owner[run] + 1], each)  # always so where keys are unique
    return kernels.cover(int(first[-1]), window[goes & inside], length), first


def spans_of(hit: np.ndarray, owner: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Of each text the maximal runs of hit symbols, as structs of start and length."""
    start = hit.copy()
    start[1:] &= ~(hit[:-1] & (owner[1:] == owner[:-1]))
    stop = hit.copy()
    stop[:-1] &= ~(hit[1:] & (owner[1:] == owner[:-1]))
    at, to = np.flatnonzero(start), np.flatnonzero(stop) + 1
    text = owner[at]
    bounds = pa.array(np.searchsorted(text, np.arange(len(first))), pa.int32())
    return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(at - first[text]), pa.array(to - at)], ["start", "length"]))


#: The type of spans_of.
SPANS = T.ArrayType(T.StructType([T.StructField("start", _LONG), T.StructField("length", _LONG)]))
