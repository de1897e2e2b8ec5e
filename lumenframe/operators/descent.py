"""Approximate nearest neighbours of all rows by neighbour descent: neighbours of neighbours are likely neighbours.

Lists start from blocks: in each of some trees a row is dealt to the blocks of the few pivots, drawn rows, that are nearest to it, and rows of a block
are compared with each other. Then, in rounds, every row brings its neighbours together, forward and reverse ones, of which it samples a bounded
number, and each two of them that weren't compared by it before are. A list keeps its nearest; rounds end when hardly any list changes.

A vector that is sent to a block meets all rows there, one that is sent to a row of a round at most ``4 * sample``: so blocks are large and find
most neighbours, and rounds find what lies across blocks. What leaves a block or a round are pairs that would enter a list as far as it was known.

The work of blocks and of rounds is linear in the number of rows: a row meets at most about ``trees * SPILL**2 * LEAF`` rows in blocks, and brings at most
``4 * sample`` rows together. Everything is keyed joins; a row that is a neighbour of very many - a hub - is sampled before it is shuffled, and its
vector is joined to its mentions, which Spark can split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import map_arrow
from ..functions.storage import Workspace
from .vectors import _usable

#: Rows a pivot has, about, if each row went to one block of a tree: fewer pivots cut off less of a row's neighbours.
LEAF = 1024
#: Blocks of a tree that a row is dealt to, where there are at least ``APART`` times as many.
SPILL, APART = 4, 16
#: No more than so many rows and numbers of one block are compared; copies of one vector fall into several parts of it.
MOST, MOST_NUMBERS = 4 * SPILL * LEAF, 1 << 23
#: Numbers of the pivots of one level: with more blocks, they are pairs (or more) of pivots of several levels.
PIVOT_NUMBERS = 1 << 16
#: Numbers of distances that are held at once: in a round, in a block.
HELD, NEAR = 1 << 22, 1 << 18
#: More than a distance that is rounded to nine digits may differ from itself.
SLACK = 2e-9
#: Bytes that one task sorts.
TASK_BYTES = 1 << 26

PAIRS = "src long, dst long, distance double"


def _vectors(df: DataFrame, key: str, vector: str, work: Workspace) -> tuple[DataFrame, np.dtype, int]:
    """(id, v): each usable vector's numbers as bytes, saved; their type and length. Of rows that repeat a key one is kept."""
    kind = df.schema[vector].dataType.elementType
    wide = np.dtype(np.float32) if isinstance(kind, T.FloatType) else np.dtype(np.float64)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if wide == np.float32 else "array<double>").alias("v")).where(F.col("id").isNotNull() & _usable("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            values, at = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            blobs = pa.array([values[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), blobs], ["id", "v"])

    packed = work.save(map_arrow(rows, run, "id long, v binary").groupBy("id").agg(F.min("v").alias("v")))
    least, most = packed.agg(F.min(F.length("v")), F.max(F.length("v"))).first()
    if least != most:
        raise ValueError(f"vectors differ in length: {least // wide.itemsize} to {most // wide.itemsize}")
    return packed, wide, (least or 0) // wide.itemsize


def _stacked(column: pa.Array, wide: np.dtype, size: int) -> np.ndarray:
    data = column.buffers()[2]
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(data, wide, len(column) * size, int(first)).reshape(len(column), size)


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    """In double; for cosine at length 1, where zero vectors stay zero."""
    x = x.astype(np.float64)
    if metric == "cosine":
        length = np.sqrt((x * x).sum(-1, keepdims=True))
        x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    return x


def _between(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of x to all of y, also of stacks of matrices."""
    near = x @ np.swapaxes(y, -1, -2)
    if metric == "cosine":
        return np.subtract(1, near, out=near)
    square = lambda z: np.einsum("...id,...id->...i", z, z)
    return np.sqrt(np.maximum(square(x)[..., :, None] + square(y)[..., None, :] - 2 * near, 0))


def _tasks(rows: DataFrame, n: int, each: int) -> int:
    """Tasks for ``n`` rows of ``each`` bytes."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * each // TASK_BYTES))


def _pivots(rows: DataFrame, wide: np.dtype, size: int, n: int, count: int, metric: str, seed: int) -> np.ndarray:
    """``count`` vectors, fewer if there are no more, that the hash of their keys draws."""
    span = 1 << 31
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(span))
    drawn = rows.select(draw.alias("draw"), "id", "v").where(F.col("draw") < min(span, span * (2 * count + 64) // max(1, n))).collect()
    drawn = sorted(drawn, key=lambda r: (r["draw"], r["id"]))[:count]
    return _prepared(np.frombuffer(b"".join(r["v"] for r in drawn), wide).reshape(len(drawn), size), metric)


def _forest(known: DataFrame, wide: np.dtype, size: int, n: int, k: int, metric: str, trees: int, seed: int) -> DataFrame:
    """(src, dst, distance) of rows (id, v, worst): the nearest ``k`` of each row in its blocks of each tree, as far as they are no farther than ``worst``."""
    need, most = max(1, math.ceil(n / LEAF)), max(2, PIVOT_NUMBERS // max(1, size))
    levels = max(1, math.ceil(math.log(need, most) - 1e-9))
    each = math.ceil(need ** (1 / levels) - 1e-9)
    spill = max(1, min(SPILL, need // APART))
    spills = [spill] if levels == 1 else [math.isqrt(spill)] * 2 + [1] * (levels - 2)
    drawn = _pivots(known, wide, size, n, trees * levels * each, metric, seed)
    groups = [drawn[i :: trees * levels] for i in range(trees * levels)]
    shared = known.sparkSession.sparkContext.broadcast(groups)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _prepared(_stacked(batch.column("v"), wide, size), metric)
            for tree in range(trees):
                blocks = [np.zeros(len(x), np.int64)]
                for level, wanted in enumerate(spills):
                    p = shared.value[tree * levels + level]
                    if not len(p):
                        continue
                    # rounded, so that copies go the same way in any batch
                    near = np.round(x @ p.T - (0 if metric == "cosine" else (p * p).sum(1) / 2), 9)
                    at = []
                    for _ in range(min(wanted, len(p))):
                        at.append(near.argmax(1))
                        near[np.arange(len(x)), at[-1]] = -np.inf
                    blocks = [b * each + a for b in blocks for a in at]
                for block in blocks:
                    columns = [pa.array(np.full(len(x), tree, np.int32)), pa.array(block), batch.column("id"), batch.column("worst"), batch.column("v")]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "block", "id", "worst", "v"])

    placed = map_arrow(known.select("id", "worst", "v"), sides, "tree int, block long, id long, worst double, v binary")
    limit = max(2 * LEAF, min(MOST, MOST_NUMBERS // max(1, size)))
    sizes = placed.groupBy("tree", "block").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts"))
    # one short row for each block; broadcast, so that vectors are shuffled once
    dealt = placed.join(F.broadcast(sizes), ["tree", "block"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts"))).drop("parts")
    keys = ["tree", "block", "part"]

    def compare(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(group)  # at most about ``limit`` rows
        ids, worst = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in ("id", "worst"))
        x = _prepared(np.concatenate([_stacked(b.column("v"), wide, size) for b in got]), metric)
        order = np.argsort(ids)
        ids, worst, x = ids[order], worst[order], x[order]
        step = max(1, NEAR // len(ids))
        for low in range(0, len(ids), step):
            d, bound = _between(x[low : low + step], x, metric), worst[low : low + step, None].copy()
            d[np.arange(len(d)), low + np.arange(len(d))] = np.inf
            ok = d <= bound + SLACK
            many = np.flatnonzero(np.count_nonzero(ok, axis=1) > k)
            if len(many):
                bound[many] = np.minimum(bound[many], np.partition(d[many], k - 1, axis=1)[:, k - 1 : k])
                ok[many] = d[many] <= bound[many] + SLACK
            i, j = np.divmod(np.flatnonzero(ok), len(ids))
            distance = d[i, j]
            order = np.lexsort((j, np.round(distance, 9), i))
            i, j, distance = i[order], j[order], distance[order]
            ok = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(distance)
            columns = [ids[low + i[ok]], ids[j[ok]], distance[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["src", "dst", "distance"])

    tasks = _tasks(known, n * trees * math.prod(spills), size * wide.itemsize + 64)
    return dealt.repartition(tasks, *keys).groupBy(*keys).applyInArrow(compare, PAIRS)


def _nearest(pairs: DataFrame, k: int, tasks: int) -> DataFrame:
    """(src, dst, distance, since, used): of pairs, which may repeat, the k nearest of each src, of equals the smaller dst."""
    apart = pairs.repartition(tasks, "src").groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.min("since").alias("since"), F.max("used").alias("used"))
    order = Window.partitionBy("src").orderBy(F.round("distance", 9), "dst")
    return apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _sampled(lists: DataFrame, sample: int, seed: int, tasks: int) -> DataFrame:
    """(at, of, fresh, met): the rows that each row ``at`` brings together, if one of them is ``fresh``: it wasn't brought together by it before. ``met``
    ones are fresh ones of its own list."""
    draw = lambda a, b: F.xxhash64(a, b, F.lit(seed))
    both = lists.select(F.col("src").alias("at"), F.col("dst").alias("of"), (~F.col("used")).alias("fresh"), F.lit(True).alias("own"))
    both = both.unionAll(lists.select(F.col("dst").alias("at"), F.col("src").alias("of"), (~F.col("used")).alias("fresh"), F.lit(False).alias("own")))
    order = Window.partitionBy("at", "fresh", "own").orderBy(draw("at", "of"), "of")
    chosen = both.repartition(tasks, "at").withColumn("i", F.row_number().over(order)).where(F.col("i") <= sample)
    members = chosen.groupBy("at", "of").agg(F.max("fresh").alias("fresh"), F.max(F.col("fresh") & F.col("own")).alias("met"))
    return members.withColumn("any", F.max("fresh").over(Window.partitionBy("at"))).where("any").drop("any")


def _local_joins(brought: DataFrame, wide: np.dtype, size: int, metric: str) -> DataFrame:
    """(src, dst, distance) of rows (at, of, fresh, worst, v), those of one ``at`` one after the other in one task: the pairs that a row brought together,
    one of them fresh, that would enter a list as far as it was known."""

    def pairs(at: np.ndarray, ids: np.ndarray, fresh: np.ndarray, worst: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        count = np.diff(np.append(start, len(at)))
        for width in np.unique(count):
            rows = np.flatnonzero(count == width)
            step = max(1, HELD // int(width * max(width, size)))
            for i in range(0, len(rows), step):
                here = start[rows[i : i + step], None] + np.arange(width)
                v = _prepared(x[here], metric)
                d, a, f, w = _between(v, v, metric), ids[here], fresh[here], worst[here]
                ok = (d <= w[:, :, None] + SLACK) & (f[:, :, None] | f[:, None, :]) & (a[:, :, None] != a[:, None, :])
                g, p, q = np.nonzero(ok)
                ok = np.round(d[g, p, q], 9) <= np.round(w[g, p], 9)
                g, p, q = g[ok], p[ok], q[ok]
                yield pa.RecordBatch.from_arrays([pa.array(a[g, p]), pa.array(a[g, q]), pa.array(d[g, p, q])], ["src", "dst", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if len(batch):
                new = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "of", "fresh", "worst")), _stacked(batch.column("v"), wide, size)]
                held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
                cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if held[0][0] != held[0][-1] else 0
                if cut:
                    yield from pairs(*(c[:cut] for c in held))
                    held = [c[cut:].copy() for c in held]
        if held is not None:
            yield from pairs(*held)

    return map_arrow(brought.select("at", "of", "fresh", "worst", "v"), run, PAIRS)


def approximate_neighbours(df: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", search: int | None = None, sample: int = 25, trees: int = 6, rounds: int = 12, least_changes: float = 0.002, seed: int = 0) -> DataFrame:
    """(src, dst, rank, distance): about the k nearest other rows of each, of equals the smaller key; distances are exact.

    search: the length of the lists that descend, k plus 35 unless given: longer ones find more. sample: how many fresh and how many old rows, each way, a
    row brings together in a round. Rounds end when fewer than ``least_changes`` of all list places changed, or after ``rounds``. The same rows
    give the same lists, however they lie in tasks.

    Rows with a null key, or a vector that is null or empty or holds null or non-finite components, take no part; vectors of different
    lengths are an error; of rows that repeat a key one takes part; a zero vector is at cosine distance 1 of all; an empty table gives
    no rows. If there are at most k other rows, all of them are neighbours once they were met."""
    work = Workspace(df.sparkSession, "descent")
    search = search or k + 35
    rows, wide, size = _vectors(df, key, vector, work)
    n = rows.count()
    few, many = _tasks(rows, n * search, 64), _tasks(rows, n * 4 * sample, size * wide.itemsize + 64)

    def known(lists: DataFrame | None) -> DataFrame:
        if lists is None:
            return rows.withColumn("worst", F.lit(float("inf")))
        worst = lists.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= search, F.max("distance")).otherwise(float("inf")).alias("worst"))
        return rows.join(worst, "id", "left").select("id", "v", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))

    lists, done = None, 0
    while lists is None or done < trees:  # the first tree tells how near neighbours are, so that later ones send less
        now = max(1, min(trees - done, done + 1))
        found = _forest(known(lists), wide, size, n, search, metric, now, seed + 1000 * done).select("*", F.lit(0).alias("since"), F.lit(False).alias("used"))
        new = work.save(_nearest(found if lists is None else lists.unionByName(found), search, few))
        work.drop(lists)
        lists, done = new, done + now
    for turn in range(1, rounds + 1):
        members = work.save(_sampled(lists, sample, seed + turn, 2 * few))
        brought = members.join(known(lists).withColumnRenamed("id", "of").hint("merge"), "of").repartition(many, "at").sortWithinPartitions("at", "of")
        found = _local_joins(brought, wide, size, metric).select("*", F.lit(turn).alias("since"), F.lit(False).alias("used"))
        met = members.where("met").select(F.col("at").alias("src"), F.col("of").alias("dst"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("since"), F.lit(True).alias("used"))
        new = work.save(_nearest(lists.unionByName(met).unionByName(found), search, few))
        changed = new.where(F.col("since") == turn).count()
        work.drop(lists, members)
        lists = new
        if changed <= least_changes * n * search:
            break
    order = Window.partitionBy("src").orderBy(F.round("distance", 9), "dst")
    return lists.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("src", "dst", "rank", "distance")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of ``exact`` pairs that ``found`` has."""
    both = exact.select("src", "dst").join(found.select("src", "dst", F.lit(1.0).alias("hit")), ["src", "dst"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
