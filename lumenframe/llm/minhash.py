"""Near-duplicate documents by MinHash with tensored banding, verified exactly on full shingle sets.

Two small collections of ``HALVES`` half-keys, each of ``ROWS`` minhash values, are computed for every distinct
shingle set; each pair of a half-key of the first and one of the second is the key of a table. So
2 * HALVES * ROWS hash functions serve HALVES ** 2 tables. A pair of Jaccard similarity s shares a table with
probability (1 - (1 - s ** ROWS) ** HALVES) ** 2: 0.99991 at s = 0.8, 3e-6 at s = 0.05.

Documents with equal sets (128 bits of hash) form one node, so copies cost nothing further. The members of a bucket are compared on full
sets with one of them, its centre, which gives most components. A colliding pair that this leaves open has both ends in one star - the
members of all buckets of one centre - and one of them outside the star's largest component. So the members outside it are joined
with all members of the star, block against block, through an inverted index of each set's rarest shingles: sets that are similar
enough share one of these. What leaves a block is its links. After that every colliding pair has been decided or is connected anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .components import components
from .work import Workspace, free_name, integer_id, join_by_size, map_arrow, salted_join, tasks

SHINGLE = 5
PERCENT = 80
HALVES = 14
ROWS = 3
#: Bytes of shingle sets on the two sides of a block.
OUTER_BYTES = 1 << 20
INNER_BYTES = 2 << 20
#: Bytes of sets, or shingles of pairs, that are compared at once.
CHUNK = 4 << 20
#: Rows of tables that one task makes.
TABLE_ROWS = 2_000_000
SEED = 20240229


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, text after text, and where each text's begin.

    A text of fewer than k words, but not none, has one shingle: all its words."""
    lower = kernels.LOWER[data]
    starts, ends, text = kernels.spans(lower, offsets, kernels.NON_SPACE)
    symbols = kernels.span_hash(lower, starts, ends)
    n = len(offsets) - 1
    counts = np.bincount(text, minlength=n)
    grams = kernels.gram_hash(symbols, k)
    whole = np.flatnonzero(text[: len(grams)] == text[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
    hashes, owner = [grams[whole]], [text[whole]]
    first = np.cumsum(counts) - counts
    for short in range(1, k):
        few = np.flatnonzero(counts == short)
        if len(few):
            at = first[few][:, None] + np.arange(short)
            hashes.append(kernels.gram_hash(symbols[at].reshape(-1), short)[::short])
            owner.append(few)
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(n + 1))


def _identities(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each non-empty set."""
    at, size = bounds[:-1], np.diff(bounds).astype(np.uint64)
    sums = [np.add.reduceat(kernels.mix(h + np.uint64(seed)), at) for seed in (7, 0x5851F42D4C957F2D)]
    mixed = np.bitwise_xor.reduceat(kernels.mix(h ^ np.uint64(0x2545F4914F6CDD1D)), at)
    return kernels.signed(kernels.mix(kernels.mix(sums[0] + size) ^ np.bitwise_xor.reduceat(h, at))), kernels.signed(kernels.mix(kernels.mix(sums[1] ^ size) + mixed))


def features(df: DataFrame, k: int, halves: int, rows: int) -> DataFrame:
    """id, n, the set's identity p and q, and the half-keys a and b of every row of (id, text); the last four are null without words."""
    multipliers = _multipliers(2 * halves * rows)
    long, longs = T.LongType(), T.ArrayType(T.LongType(), False)
    schema = T.StructType([df.schema["id"], T.StructField("n", long, False), T.StructField("p", long), T.StructField("q", long), T.StructField("a", longs), T.StructField("b", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernels.text_slices(batch):
                h, bounds = shingle_sets(data, offsets, k)
                sizes = np.diff(bounds)
                some = sizes > 0
                full = np.append(bounds[:-1][some], len(h))
                keys = np.zeros((2 * halves, int(some.sum())), np.uint64)
                p, q = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
                if some.any():
                    p[some], q[some] = _identities(h, full)
                    for i, multiplier in enumerate(multipliers):
                        least = np.minimum.reduceat((h ^ (multiplier >> np.uint64(7))) * multiplier, full[:-1])
                        keys[i // rows] = kernels.mix(keys[i // rows] + least)
                at = np.full(high - low, -1)
                at[some] = np.arange(int(some.sum()))
                index = pa.array(at, mask=~some)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(kernels.signed(np.ascontiguousarray(part.T)).reshape(-1)), halves).cast(pa.list_(pa.int64())).take(index) for part in (keys[:halves], keys[halves:])]
                columns = [batch.column("id").slice(low, high - low), pa.array(sizes), pa.array(p, mask=~some), pa.array(q, mask=~some), *lists]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_arrow(df, run, schema)


def _full_sets(df: DataFrame, k: int) -> DataFrame:
    """(node, set) of rows (node, p, q, text); rows whose text isn't the node's are left out (ids that aren't unique)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernels.text_slices(batch):
                h, bounds = shingle_sets(data, offsets, k)
                some = np.flatnonzero(np.diff(bounds) > 0)
                if not len(some):
                    continue
                p, q = _identities(h, np.append(bounds[some], len(h)))
                node, want_p, want_q = (batch.column(c).slice(low, high - low).to_numpy()[some] for c in ("node", "p", "q"))
                right = np.flatnonzero((p == want_p) & (q == want_q))
                sets = [h[bounds[i] : bounds[i + 1]].tobytes() for i in some[right].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(node[right]), pa.array(sets, pa.binary())], ["node", "set"])

    return map_arrow(df, run, T.StructType([T.StructField("node", T.LongType(), False), T.StructField("set", T.BinaryType(), False)]))


def _elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a column of sets, and where each set's begin."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data[bounds[0] : bounds[-1]]).view(np.uint64), (bounds - bounds[0]) // 8


def _linked(percent: int):
    """Of rows (u, v, set_u, set_v) those whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(8 * np.diff(_elements(batch.column(c))[1]) for c in ("set_u", "set_v"))
            for low, high in kernels.slices(np.concatenate([[0], np.cumsum(size)]), CHUNK):
                part = batch.slice(low, high - low)
                (x, at_x), (y, at_y) = _elements(part.column("set_u")), _elements(part.column("set_v"))
                rows = np.concatenate([np.repeat(np.arange(high - low), np.diff(at)) for at in (at_x, at_y)])
                h = np.concatenate([x, y])
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                both = np.bincount(rows[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])], minlength=high - low)
                good = pa.array(100 * both >= percent * (np.diff(at_x) + np.diff(at_y) - both))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(good) for c in ("u", "v")], ["u", "v"])

    return run


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    halves: int = HALVES,
    rows: int = ROWS,
) -> DataFrame:
    """Per row of ``df``: its id, n_shingles, component_id (the smallest id it reaches over links), kept (its own id is that).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. Words are what ASCII
    white space separates, with A-Z in lower case. Null or empty texts have no shingles, link to nothing and are their own component.
    Rows with a null id count as kept and have a null component_id, and no other row's depends on them.
    Rows that share an id are looked at one by one. Ids are integers. An empty table gives no rows; other columns aren't read. Sets are
    equal if 128 bits of their hash are.
    """
    work = Workspace(df.sparkSession, "minhash")
    docs = df.select(integer_id(df, id_col).alias("id"), df[text_col].cast("string").alias("text"))
    found = work.save(features(docs, shingle, halves, rows))
    sets = found.where("n > 0 and id is not null").groupBy("p", "q").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    nodes = work.save(sets.withColumn("node", F.monotonically_increasing_id()))  # fixed by being saved
    label = _components_of(docs, nodes, shingle, percent, halves, work)
    least = nodes.select("node", "id").join(label, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    smallest = least.groupBy("component").agg(F.min("id").alias("component_id"))
    of_node = work.save(nodes.select("node", "p", "q", "copies").join(least.join(smallest, "component").select("node", "component_id"), "node").drop("node"))
    rows = found.select("id", "n", "p", "q")
    usual = rows.where("n > 0 and id is not null")
    joined = join_by_size(usual, of_node, ["p", "q"], "copies", usual.count())
    out = joined.select("id", "n", "component_id").unionByName(rows.where("n = 0 or id is null").select("id", "n", F.lit(None).cast("long").alias("component_id")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _components_of(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, halves: int, work: Workspace) -> DataFrame:
    """(node, component) of the nodes that share a table with others."""
    count = nodes.count()
    dealt = nodes.select("node", "n", "a", "b").repartition(tasks(nodes.sparkSession, count * halves * halves, TABLE_ROWS))
    table = dealt.select("node", "n", F.posexplode("a").alias("i", "x"), "b").select("node", "n", "i", "x", F.posexplode("b").alias("j", "y"))
    table = table.select(F.xxhash64("i", "j", "x", "y").alias("key"), "node", F.col("n").cast("int").alias("n"))
    buckets = table.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("high"), F.count("*").alias("size")).where("centre < high")
    buckets = work.save(buckets.select("key", "centre", "size"))
    members = join_by_size(table, buckets, ["key"], "size", count * halves * halves)
    pairs = members.where("node <> centre").select("centre", "node", "n").distinct()
    stars = work.save(pairs.join(nodes.select(F.col("node").alias("centre"), F.col("n").cast("int").alias("m")), "centre"))
    work.drop(buckets)
    label = work.save(stars.select("node").unionAll(stars.select("centre")).distinct().withColumn("component", F.col("node")))
    wanted = label.join(nodes.select("node", "id", "p", "q"), "node")
    sets = work.save(_full_sets(docs.join(wanted, "id").select("node", "p", "q", "text"), shingle).dropDuplicates(["node"]))
    links = _compared(stars, sets, percent, work)
    label = _merged(label, links, work)
    crossed = _crossed(stars, sets, label, percent, work)
    label = _merged(label, crossed, work)
    work.drop(stars, sets, links, crossed)
    return label


def _compared(stars: DataFrame, sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(u, v) for the links of members with their centres."""
    pairs = stars.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select(F.col("centre").alias("u"), F.col("node").alias("v"))
    second = pairs.join(sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v")
    first = sets.select(F.col("node").alias("u"), F.col("set").alias("set_u"))
    both = salted_join(second, first, "u", "v", pairs.groupBy("u").agg(F.count("*").alias("size")), "size", stars.count())
    return work.save(map_arrow(both.select("u", "v", "set_u", "set_v"), _linked(percent), "u long, v long"))


def _crossed(stars: DataFrame, sets: DataFrame, label: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(u, v) for the links between components of the members of one centre.

    Members outside a star's largest component meet all its members, block against block: a block holds ``OUTER_BYTES`` and ``INNER_BYTES``
    of shingle sets, and only links leave it."""
    known = work.save(stars.select("centre", "node", "n").join(label, "node"))
    sizes = known.groupBy("centre", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    largest = F.max(F.struct("k", "component", "n"))
    stats = sizes.groupBy("centre").agg(largest.alias("l"), F.sum("n").alias("all"), F.sum("k").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda shingles, size: F.ceil(shingles * 8 / size).cast("int")
    stats = work.save(stats.select("centre", "size", F.col("l.component").alias("largest"), blocks(F.col("all") - F.col("l.n"), OUTER_BYTES).alias("outers"), blocks(F.col("all"), INNER_BYTES).alias("inners")))
    rows = work.save(join_by_size(known, stats, ["centre"], "size", known.count()))
    part = lambda n: F.pmod(F.hash("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = rows.where("component <> largest").select("centre", "node", "component", part("outers").alias("o"), every("inners").alias("i"), F.lit(True).alias("outer"))
    inner = rows.select("centre", "node", "component", every("outers").alias("o"), part("inners").alias("i"), F.lit(False).alias("outer"))
    filled = outer.unionByName(inner).join(sets, "node")
    out = work.save(filled.groupBy("centre", "o", "i").applyInArrow(_block_links(percent), "u long, v long"))
    work.drop(known, stats, rows)
    return out


def similar_pairs(outer: tuple[np.ndarray, np.ndarray], inner: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of outer, row of inner) of sets with 100 * intersection >= percent * union; sets are non-empty: shingles and bounds.

    Similar sets a and b have at least percent of a's shingles in common, so with shingles in one order, the rarest first, the first
    |a| - ceil(percent * |a|) + 1 of a and of b share one. Only pairs that share one of these are counted, some at a time."""
    (x, at_x), (y, at_y) = outer, inner
    n_x, n_y = np.diff(at_x), np.diff(at_y)
    known, ids, often = np.unique(np.concatenate([x, y]), return_inverse=True, return_counts=True)
    place = np.empty(len(known), np.int64)
    place[np.argsort(often, kind="stable")] = np.arange(len(known))
    ids = place[ids.reshape(-1)]

    def ordered(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((ids, row))
        first = kernels.ranges(sizes) < np.repeat(sizes - (sizes * percent + 99) // 100 + 1, sizes)
        return ids[order], row, first

    a, row_a, first_a = ordered(ids[: len(x)], n_x)
    b, row_b, first_b = ordered(ids[len(x) :], n_y)
    keys_b = row_b * len(known) + b  # ascending
    order = np.argsort(b[first_b], kind="stable")
    posted, who = b[first_b][order], row_b[first_b][order]
    asked, asking = a[first_a], row_a[first_a]
    low, high = np.searchsorted(posted, asked), np.searchsorted(posted, asked, "right")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for begin, end in kernels.slices(np.concatenate([[0], np.cumsum(np.bincount(asking, weights=high - low, minlength=len(n_x)).astype(np.int64))]), CHUNK // 8):
        mine = (asking >= begin) & (asking < end)
        many = (high - low)[mine]
        pairs = np.unique(np.repeat(asking[mine], many) * len(n_y) + who[np.repeat(low[mine], many) + kernels.ranges(many)])
        i, j = pairs // len(n_y), pairs % len(n_y)
        fit = np.minimum(n_x[i], n_y[j]) * 100 >= np.maximum(n_x[i], n_y[j]) * percent
        i, j = i[fit], j[fit]
        for p, q in kernels.slices(np.concatenate([[0], np.cumsum(n_x[i])]), CHUNK // 8):
            size = n_x[i[p:q]]
            wanted = np.repeat(j[p:q], size) * len(known) + a[np.repeat(at_x[i[p:q]], size) + kernels.ranges(size)]
            near = keys_b[np.minimum(np.searchsorted(keys_b, wanted), len(keys_b) - 1)] == wanted
            both = np.bincount(np.repeat(np.arange(q - p), size), weights=near, minlength=q - p).astype(np.int64)
            good = 100 * both >= percent * (size + n_y[j[p:q]] - both)
            found.append((i[p:q][good], j[p:q][good]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        outer = table.column("outer").to_numpy()
        sides = [table.filter(pa.array(flag)) for flag in (outer, ~outer)]
        if not all(len(side) for side in sides):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        i, j = similar_pairs(*(_elements(side.column("set").combine_chunks()) for side in sides), percent)
        (u, c), (v, d) = ((side.column("node").to_numpy(), side.column("component").to_numpy()) for side in sides)
        new = c[i] != d[j]
        return pa.table({"u": u[i[new]], "v": v[j[new]]})

    return run


def _merged(label: DataFrame, links: DataFrame, work: Workspace) -> DataFrame:
    """``label`` after ``links`` (u, v)."""
    u, v = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    between = work.save(links.join(u, "u").join(v, "v").where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())
    if between.isEmpty():
        return label
    moved = components(between, work).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return work.save(label.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one row of each near-duplicate component: that of the smallest id (rows with a null id stay).

    Rows that repeat an id are one document; if its id is kept, so are all of them. Columns as they were."""
    key = free_name("the_id", df)
    drop = near_duplicates(df, id_col, text_col, **options).where(~F.col("kept")).select(F.col(id_col).alias(key)).distinct()
    return df.join(drop, df[id_col] == F.col(key), "left_anti")
