"""Benchmark decontamination with suffix arrays of the training text.

A shard is a few megabytes of training documents. Its suffix array orders all its words' suffixes, each up to the end of its
document. Every test suffix is binary-searched in the array of every shard: the suffixes of training text that begin with its first ten
words (or with all words of a shorter item) are an interval of all places of such matches. Words inside any of them are hit, and a document has the items of the intervals
it has places in; neither needs the pairs of a suffix and a place. Where the longest verbatim matches are asked for, each match that can't be
extended to the left is followed to its end, and they come out with item, document and places. Test suffixes whose first three words stand
nowhere in a shard can't match there and are not searched in it. Words are compared by 64 bits of hash.

Documents stay where they are: the plan is a scan and one map for each block of test items, without a shuffle. A block of items, at most
``BLOCK_BYTES`` of text, is all that the driver holds and that is broadcast; with more than one block the result of each is saved
before the next is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .work import Workspace, free_name, map_arrow, without

WINDOW = 10
PREFIX = 3
BLOCK_BYTES = 8 << 20
#: Pairs that are written out at once.
PAIRS = 1 << 20
RESULTS = ["n_words", "spans", "items", "matches"]
_INT = T.IntegerType()
_SPAN = T.ArrayType(T.StructType([T.StructField("start", _INT, False), T.StructField("end", _INT, False)]), False)
_ITEMS = T.ArrayType(T.StringType(), False)
_MATCHES = T.ArrayType(T.StructType([T.StructField("item", T.StringType(), False), *(T.StructField(n, _INT, False) for n in ("item_start", "start", "length"))]), False)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with a 0 after each text, and how many words each text has."""
    lower = kernels.LOWER[data]
    starts, ends, text = kernels.spans(lower, offsets, kernels.ALNUM)
    counts = np.bincount(text, minlength=len(offsets) - 1)
    symbols = np.zeros(len(starts) + len(counts), np.uint64)
    symbols[np.arange(len(starts)) + text] = kernels.span_hash(lower, starts, ends)
    return symbols, counts


class Items:
    """A block of test items: their words, and the suffixes that can hold a window."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int):
        data, offsets = kernels.utf8(pa.array(texts, pa.large_string()))
        self.ids, self.width = np.array(ids, dtype=object), width
        self.words, counts = _words(data, offsets)
        each = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        self.owner = np.repeat(np.arange(len(counts)), each)
        self.first = (np.cumsum(counts + 1) - counts - 1)[self.owner]
        self.start = kernels.ranges(each)
        self.size = np.minimum(counts, width)[self.owner]  # of the window at a suffix's beginning
        depth = np.minimum(self.size, PREFIX)
        self.prefixes = {}
        for d in range(1, min(PREFIX, width) + 1):
            mine = np.flatnonzero(depth == d)
            if len(mine):
                grams = kernels.gram_hash(np.append(self.words, np.zeros(d, np.uint64)), d)[(self.first + self.start)[mine]]
                keys, which = np.unique(grams, return_inverse=True)
                table = np.zeros(1 << 20, bool)
                table[keys >> np.uint64(44)] = True
                self.prefixes[d] = keys, table, mine, which.reshape(-1)

    def standing_in(self, symbols: np.ndarray) -> np.ndarray:
        """The suffixes whose first words stand somewhere among ``symbols``."""
        found = []
        for d, (keys, table, mine, which) in self.prefixes.items():
            grams = kernels.gram_hash(symbols, d)
            grams = grams[table[grams >> np.uint64(44)]]
            near = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            there = np.zeros(len(keys), bool)
            there[near[keys[near] == grams]] = True
            found.append(mine[there[which]])
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Shard:
    """The suffix array of some texts' words. symbols: word hashes with a 0 after each text."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        self.known, ids = np.unique(np.append(symbols, np.uint64(0)), return_inverse=True)  # the 0 is the smallest
        self.ids = ids.reshape(-1)[:-1]
        self.left = np.repeat(np.cumsum(counts + 1) - 1, counts + 1) - np.arange(len(symbols))
        self.array = self._sorted()

    def _sorted(self) -> np.ndarray:
        """Words' places in the order of their suffixes: by the first few words at once, then by doubling where that leaves equals."""
        ids, left, n = self.ids, self.left, len(self.ids)
        bits = max(1, len(self.known).bit_length())
        depth = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for k in range(depth):
            key <<= bits
            key[: n - k] += np.where(left[: n - k] > k, ids[k:], 0) if k else ids
        at = np.flatnonzero(left > 0)
        order = at[np.argsort(key[at], kind="stable")]
        rank = np.zeros(n, np.int64)  # 1 + the first slot of a group of equals; 0 beyond a text
        new = np.append(True, key[order[1:]] != key[order[:-1]]) if len(order) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        rank[order] = np.repeat(begin, np.diff(np.append(begin, len(order)))) + 1
        longest = int(left.max()) if n else 0
        slots = np.flatnonzero(np.repeat(np.diff(np.append(begin, len(order))) > 1, np.diff(np.append(begin, len(order)))))
        while len(slots) and depth <= longest:
            part = order[slots]
            follow = np.where(left[part] > depth, rank[np.minimum(part + depth, n - 1)], 0)
            group = rank[part]
            sort = np.lexsort((part, follow, group))
            part, follow, group = part[sort], follow[sort], group[sort]
            order[slots] = part
            new = np.append(True, (follow[1:] != follow[:-1]) | (group[1:] != group[:-1]))
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(part)))
            rank[part] = np.repeat(slots[begin], size) + 1
            slots = slots[np.repeat(size > 1, size)]
            depth *= 2
        return order

    def translated(self, words: np.ndarray) -> np.ndarray:
        """Twice the number of each word here; odd between its neighbours for one that isn't there."""
        at = np.searchsorted(self.known, words)
        there = self.known[np.minimum(at, len(self.known) - 1)] == words
        return 2 * at - ~there

    def interval(self, queries: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``queries`` (translated words) the interval of suffixes that begin with its first ``size`` words."""
        width = queries.shape[1]
        column = np.arange(width)
        padded = np.append(self.ids, np.zeros(width, self.ids.dtype))

        def bound(upper: bool) -> np.ndarray:
            low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.array))
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) // 2
                have, want = 2 * padded[self.array[middle][:, None] + column], queries[open_]
                differs = (have != want) & (column < size[open_, None])
                place, row = differs.argmax(axis=1), np.arange(len(open_))
                right = np.where(differs[row, place], have[row, place] < want[row, place], upper)
                low[open_] = np.where(right, middle + 1, low[open_])
                high[open_] = np.where(right, high[open_], middle)
            return low

        return bound(False), bound(True)


def _marks(x: np.ndarray) -> np.ndarray:
    """64 bits that look random, of small whole numbers."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _of_each(interval: np.ndarray, member: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct members of each interval, one interval after another; where each begins, how many it has, and a sum of their marks."""
    pairs = np.unique(interval * most + member)
    begin = np.flatnonzero(np.append(True, np.diff(pairs // most) > 0))
    member = pairs % most
    return member, begin, np.diff(np.append(begin, len(pairs))), np.add.reduceat(_marks(member), begin)


def _meetings(interval: np.ndarray, owner: np.ndarray, at: np.ndarray, text: np.ndarray, items: int, texts: int) -> np.ndarray:
    """text * items + owner, ascending, for each text and item that meet in an interval: of its suffixes' owners and its places' texts.

    The windows of a passage that many items and texts share meet in intervals of the same owners and texts, of which one is enough; the others
    are written out ``PAIRS`` at a time, so that no more is held than that and what comes out."""
    owners, first_o, many_o, sum_o = _of_each(interval, owner, items)
    others, first_t, many_t, sum_t = _of_each(at, text, texts)
    _, one = np.unique(np.stack([sum_o, sum_t], axis=1), axis=0, return_index=True)
    first_o, many_o, first_t, many_t = first_o[one], many_o[one], first_t[one], many_t[one]
    out, size = np.zeros(0, np.int64), many_o * many_t
    group = np.cumsum(size) // PAIRS
    for low, high in zip(*kernels.runs_of(group), strict=True):
        o, t = many_o[low:high], many_t[low:high]
        here, k = np.repeat(np.arange(low, high), o * t), kernels.ranges(o * t)
        pairs = others[first_t[here] + k % many_t[here]] * items + owners[first_o[here] + k // many_t[here]]
        out = np.union1d(out, pairs)
    return out


def _longest(items: Items, shard: Shard, words: np.ndarray, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each match that no other extends to the left: where it begins, the item's suffix, and its length. Pairs of a suffix and a place are
    looked at ``PAIRS`` at a time, and only these matches are kept."""
    many = high - low
    found = []
    for a, z in zip(*kernels.runs_of(np.cumsum(many) // PAIRS), strict=True):
        suffix = np.repeat(asked[a:z], many[a:z])
        start = items.first[suffix] + items.start[suffix]
        place = shard.array[np.repeat(low[a:z], many[a:z]) + kernels.ranges(many[a:z])]
        # not extended to the left: at the beginning of either text, or after different words
        first = (items.start[suffix] == 0) | (shard.ids[place - 1] == 0) | (place == 0) | (2 * shard.ids[place - 1] != words[start - 1])
        found.append((place[first], suffix[first], start[first]))
    place, suffix, start = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    length, active = items.size[suffix].copy(), np.arange(len(suffix))
    ends = np.append(words, 0)  # words of 0 end an item, and ids of 0 a document
    while len(active):
        more = ends[start[active] + length[active]]
        active = active[(more > 0) & (more == 2 * shard.ids[place[active] + length[active]])]
        length[active] += 1
    return place, suffix, length


def _find(items: Items, symbols: np.ndarray, counts: np.ndarray, longest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which symbols are hit; text * number of items + item for each that meet; and, if asked for, the longest matches.

    Suffixes that begin alike have the same interval of places. Intervals of one length lie apart, so all of them hold at most ``width`` times as many
    places as there are words, however often a word repeats."""
    hit, none = np.zeros(len(symbols), bool), np.zeros(0, np.int64)
    asked = items.standing_in(symbols)
    if not len(asked):
        return hit, none, none, none, none
    shard = Shard(symbols, counts)
    words = shard.translated(items.words)
    padded = np.append(words, np.zeros(items.width, words.dtype))
    begin = items.first[asked] + items.start[asked]
    low, high = shard.interval(padded[begin[:, None] + np.arange(items.width)], items.size[asked])
    there = low < high
    asked, low, high = asked[there], low[there], high[there]
    if not len(asked):
        return hit, none, none, none, none
    _, one, interval = np.unique(low * (items.width + 1) + items.size[asked], return_index=True, return_inverse=True)
    many = high[one] - low[one]
    at = np.repeat(np.arange(len(one)), many)
    place = shard.array[low[one][at] + kernels.ranges(many)]
    hit = kernels.cover(len(symbols), place, items.size[asked[one]][at])
    text_of = np.repeat(np.arange(len(counts)), counts + 1)
    met = _meetings(interval.reshape(-1), items.owner[asked], at, text_of[place], len(items.ids), len(counts))
    return hit, met, *(_longest(items, shard, words, asked, low, high) if longest else (none, none, none))


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _search(items: Items, data: np.ndarray, offsets: np.ndarray, before: tuple[pa.ListArray, ...] | None, longest: bool) -> list[pa.Array]:
    """n_words, spans, items and, if asked for, matches of the texts of a slice; before: what earlier blocks found."""
    n = len(offsets) - 1
    symbols, counts = _words(data, offsets)
    text_of = np.repeat(np.arange(n), counts + 1)
    first = np.cumsum(counts + 1) - counts - 1
    hit, met, place, suffix, length = _find(items, symbols, counts, longest)
    of = [set() for _ in range(n)]
    for t, i in zip((met // max(len(items.ids), 1)).tolist(), (met % max(len(items.ids), 1)).tolist(), strict=True):
        of[t].add(items.ids[i])
    matches = []
    if longest:
        text = text_of[place]
        order = np.lexsort((items.start[suffix], items.owner[suffix], place))
        text, place, suffix, length = text[order], place[order], suffix[order], length[order]
        names = pa.array(items.ids[items.owner[suffix]].tolist(), pa.string())
        fields = [names, _ints(items.start[suffix]), _ints(place - first[text]), _ints(length)]
        matches = [_lists(pa.StructArray.from_arrays(fields, ["item", "item_start", "start", "length"]), text, n)]
    if before is not None:
        spans, found, *known = before
        owner = np.repeat(np.arange(n), np.diff(np.asarray(spans.offsets)))
        start, end = (np.asarray(spans.flatten().field(f)) for f in ("start", "end"))
        hit |= kernels.cover(len(symbols), first[owner] + start, end - start)
        of = [a | set(b) for a, b in zip(of, found.to_pylist(), strict=True)]
        matches = [pa.array([a + b for a, b in zip(k.to_pylist(), m.to_pylist(), strict=True)], m.type) for k, m in zip(known, matches, strict=True)]
    starts, ends = kernels.runs(hit)
    owner = text_of[starts]
    spans = _lists(pa.StructArray.from_arrays([_ints(starts - first[owner]), _ints(ends - first[owner])], ["start", "end"]), owner, n)
    return [pa.array(counts.astype(np.int64)), spans, pa.array([sorted(x) for x in of], pa.list_(pa.string())), *matches]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, limit: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark in blocks of at most ``limit`` bytes of text (or one longer item); one at least."""
    rows = benchmark.select(benchmark[item_col].cast("string").alias("id"), benchmark[text_col].cast("string").alias("text"))
    ids: list[str] = []
    texts: list[str] = []
    size, made = 0, False
    for row in rows.toLocalIterator():
        ids.append("null" if row["id"] is None else row["id"])
        texts.append(row["text"] or "")
        size += 4 * len(texts[-1])
        if size >= limit:
            yield Items(ids, texts, width)
            ids, texts, size, made = [], [], 0, True
    if ids or not made:
        yield Items(ids, texts, width)


def find_overlaps(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
    results: list[str] | None = None,
    longest: bool = True,
) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with n_words, spans, items and matches (or the names in ``results``): how many words
    a text has, which of them (start, end) lie inside an occurrence of a test window, the ids of the items with such windows, and
    the longest verbatim matches (item, item_start, start, length in words), which ``longest`` = False leaves out.

    Windows are ``width`` consecutive words of an item, or a shorter item as a whole; words are runs of ASCII letters
    and digits and of non-ASCII characters, in lower case. A match reaches as far as both texts agree. Null and empty texts have no
    words, no spans and no items; items without words match nothing; repeated rows are searched each; empty tables on
    either side give no hits; an item without an id is called null. Item ids are strings. Other columns are passed through; one with a
    result's name gives way to it.
    """
    results = (results or RESULTS)[: None if longest else -1]
    source = without(df if keep is None else df.select(*keep), results)
    names, text_name = source.columns, free_name("the_text", df)
    out = df.withColumn(text_name, df[text_col].cast("string")).select(*names, text_name)
    types = [T.LongType(), _SPAN, _ITEMS, _MATCHES]
    schema = T.StructType([*out.schema.fields, *(T.StructField(n, t, False) for n, t in zip(results, types[: len(results)], strict=True))])
    work = Workspace(df.sparkSession, "decontaminate")

    def searching(shared, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, data, offsets in kernels.text_slices(batch, text_name):
                    part = batch.slice(low, high - low)
                    before = None
                    if not first:  # taken, so that offsets begin at 0
                        before = tuple(part.column(c).take(pa.array(np.arange(len(part)))) for c in results[1:])
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*names, text_name)), *_search(shared.value, data, offsets, before, longest)], schema.names)

        return run

    saved = None
    for number, items in enumerate(blocks(benchmark, item_col, item_text_col, width, block_bytes)):
        if number:
            last, saved = saved, work.save(out)
            work.drop(last)
            out = saved
        out = map_arrow(out, searching(df.sparkSession.sparkContext.broadcast(items), number == 0), schema)
    return out.drop(text_name)


def remove_contaminated(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` without a word inside an occurrence of a test window; columns as they were."""
    results = [free_name(f"the_{n}", df) for n in RESULTS]
    found = find_overlaps(df, benchmark, results=results, longest=False, **options)
    return found.where(F.size(results[1]) == 0).select(*df.columns)


def report(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", longest: bool = True, **options) -> DataFrame:
    """Per row of ``df``: its id, n_words, n_hit, n_items, items, spans, contaminated and, unless left out, the longest matches."""
    found = find_overlaps(df, benchmark, keep=[id_col], longest=longest, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]))
    many, dirty = F.size("items").cast("long"), F.size("spans") > 0
    return found.select(id_col, "n_words", hit.alias("n_hit"), many.alias("n_items"), "items", "spans", dirty.alias("contaminated"), *(["matches"] if longest else []))
