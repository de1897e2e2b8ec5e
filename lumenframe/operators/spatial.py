"""Joins by distance in the plane, on a grid: both sides are bucketed by cell of the grid, so they are equi-joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import map_arrow
from ..functions.storage import Workspace, free_name

#: Rows of a grid cell that are compared at once.
CELL = 4096
#: Targets of a grid cell, about, in the first ring of a search.
FEW = 4
#: Places of a cell, and of a cell and what lies around it, that meet at once, about; up to how many of the latter are all compared; and pairs that are held.
SPOTS, AROUND, PLAIN, HELD = 1 << 16, 1 << 18, 1024, 1 << 21


def _around(at: Column) -> Column:
    return F.explode(F.sequence(at - 1, at + 1))


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def radius_counts(df: DataFrame, key: str, x: str, y: str, radius: float, within: str) -> DataFrame:
    """(key, n_near): how many rows of the same group lie within ``radius``, border and the row itself included.

    Rows at one place are one place with their number; ``_counted`` counts places, and its counts are joined back to the rows. Rows with a null group
    or coordinate have no row here; rows that repeat a key are counted each."""
    rows = _points(df, key, x, y, within)
    spots = Workspace(df.sparkSession, "spots").save(rows.groupBy("g", "x", "y").agg(F.count("*").alias("m")))
    return rows.join(_counted(spots, radius), ["g", "x", "y"]).groupBy("k").agg(F.sum("n").alias("n_near")).withColumnRenamed("k", key)


def densest(df: DataFrame, key: str, x: str, y: str, radius: float, within: str) -> DataFrame:
    """(within, key, x, y, n_near): of each place of a group the row with the largest count, of equals the larger key; a key that a place repeats counts as often.

    What ``spread_out`` picks of these it would pick of all rows, as rows at one place are equally far from all others. Rows with a null group, key
    or coordinate take no part. The table is saved."""
    work = Workspace(df.sparkSession, "densest")
    times = _points(df, key, x, y, within).groupBy("g", "x", "y", "k").agg(F.count("*").alias("c"))
    best = times.groupBy("g", "x", "y").agg(F.sum("c").alias("m"), F.max(F.struct("c", "k")).alias("b"))
    spots = work.save(best.select("g", "x", "y", "m", "b.c", "b.k"))
    found = _counted(spots, radius).select("g", "k", "x", "y", (F.col("c") * F.col("n")).alias("n_near"))
    out = work.save(found.toDF(within, key, x, y, "n_near"))
    work.drop(spots)
    return out


def _points(df: DataFrame, key: str, x: str, y: str, within: str) -> DataFrame:
    return df.select(F.col(within).alias("g"), F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()


def _counted(spots: DataFrame, radius: float) -> DataFrame:
    """Places (g, x, y, m, ...) of m rows each, each once, with n: how many rows lie within ``radius``.

    Places are gathered by grid cells of twice the radius as arrays, and every cell also gets the places up to a radius around it. They meet in one Arrow map,
    at most ``SPOTS`` of a cell and ``AROUND`` of those around at once; what leaves it are counts."""
    cells, size = ["g", "gx", "gy"], 2 * radius
    more = [c for c in spots.columns if c not in ("g", "x", "y", "m")]

    def packed(at: DataFrame, columns: list[str], most: int, name: str) -> DataFrame:
        parts = at.groupBy(*cells).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
        part = F.pmod(F.xxhash64("x", "y"), F.coalesce("parts", F.lit(1))).alias("part")
        dealt = at.join(F.broadcast(parts), cells, "left").select(*cells, part, F.struct(*columns).alias("s"))  # one short row for each crowded cell
        return dealt.groupBy(*cells, "part").agg(F.collect_list("s").alias(name)).drop("part")

    def every(c: str) -> Column:
        reach = F.abs(c) * 1e-15 + radius * (1 + 1e-9)
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))

    own = packed(spots.withColumns({"gx": _cell("x", size), "gy": _cell("y", size)}), ["x", "y", *more], SPOTS, "here")
    around = packed(spots.select("g", "x", "y", "m", every("x").alias("gx")).withColumn("gy", every("y")), ["x", "y", "m"], AROUND, "there")
    both = own.join(around.hint("merge"), cells).select("g", "here", "there")
    schema = T.StructType([spots.schema[c] for c in ("g", "x", "y", *more)] + [T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                here, there = batch.column("here")[i].values, batch.column("there")[i].values
                near = _within(*(s.field(c).to_numpy() for s, c in ((here, "x"), (here, "y"), (there, "x"), (there, "y"), (there, "m"))), radius)
                group = batch.column("g").take(pa.array(np.full(len(here), i)))
                yield pa.RecordBatch.from_arrays([group, *(here.field(c) for c in ("x", "y", *more)), pa.array(near)], schema.names)

    sums = map_arrow(both, run, schema).groupBy("g", "x", "y").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in more))
    return sums.select("g", "x", "y", *more, "n")


def _within(x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray, m: np.ndarray, radius: float) -> np.ndarray:
    """The sum of m over the places (ox, oy) within ``radius`` of each (x, y).

    Others lie in strips by y, in each by x, and what is surely within is a range of a strip, whose sum is a difference of running sums. Only
    places whose distance depends on where they lie in their strip are compared one by one: about the square root of all that are within."""
    n, square = np.zeros(len(x), np.int64), radius * radius
    if len(ox) <= PLAIN:
        for low in range(0, len(x), 256):
            dx, dy = x[low : low + 256, None] - ox[None, :], y[low : low + 256, None] - oy[None, :]
            n[low : low + 256] = (dx * dx + dy * dy <= square) @ m.astype(float)  # whole numbers, so exact
        return n
    by_y = np.argsort(y)
    x, y = x[by_y], y[by_y]
    order = np.argsort(oy)
    ox, oy, m = ox[order], oy[order], m[order]
    start = np.maximum.accumulate(np.where(np.append(True, oy[1:] != oy[:-1]), np.arange(len(oy)), 0))  # where places of this y begin
    strip = start // max(1, math.isqrt(len(oy) // 2))
    order = np.lexsort((ox, strip))
    ox, m, begin = ox[order], m[order], np.flatnonzero(np.append(True, strip[1:] != strip[:-1]))
    inner_y, slack = oy[order], 4 * np.finfo(float).eps * (max(np.abs(ox).max(), np.abs(x).max()) + radius)
    reach = radius * (1 + 1e-9) + np.abs(oy).max() * 1e-15
    for low, high in zip(begin.tolist(), [*begin[1:].tolist(), len(ox)], strict=True):
        sx, sy, total, least, most = ox[low:high], inner_y[low:high], np.append(0, np.cumsum(m[low:high])), oy[low], oy[high - 1]
        first, last = np.searchsorted(y, least - reach), np.searchsorted(y, most + reach, "right")
        if first == last:
            continue
        px, py = x[first:last], y[first:last]
        outer = np.sqrt(np.maximum(square * (1 + 1e-12) - np.maximum(np.maximum(least - py, py - most), 0.0) ** 2, 0.0)) + slack
        inner = np.sqrt(np.maximum(square * (1 - 1e-12) - np.maximum(np.abs(py - least), np.abs(py - most)) ** 2, 0.0)) - slack
        a, d = np.searchsorted(sx, px - outer), np.searchsorted(sx, px + outer, "right")
        b, c = a.copy(), d.copy()
        left, right = px - inner, px + inner
        at = np.flatnonzero((a < d) & (sx[np.minimum(a, len(sx) - 1)] < left) & (inner > 0))
        b[at] = np.searchsorted(sx, left[at])
        at = np.flatnonzero((a < d) & (sx[np.maximum(d, 1) - 1] > right) & (inner > 0))
        c[at] = np.searchsorted(sx, right[at], "right")
        c = np.where(inner > 0, c, a)
        n[first:last] += total[c] - total[b]
        starts, sizes = np.concatenate([a, c]), np.concatenate([b - a, d - c])
        some = np.flatnonzero(sizes)
        starts, sizes, who = starts[some], sizes[some], some % len(px)
        ends = np.cumsum(sizes)
        low_at = 0
        while low_at < len(some):
            done = ends[low_at - 1] if low_at else 0
            high_at = max(low_at + 1, int(np.searchsorted(ends, done + HELD, "right")))
            sized = sizes[low_at:high_at]
            which = np.repeat(who[low_at:high_at], sized)
            at = np.arange(len(which)) + np.repeat(starts[low_at:high_at] - (ends[low_at:high_at] - sized - done), sized)
            dx, dy = px[which] - sx[at], py[which] - sy[at]
            ok = dx * dx + dy * dy <= square
            n[first:last] += np.bincount(which[ok], weights=m[low:high][at[ok]], minlength=len(px)).astype(np.int64)
            low_at = high_at
    out = np.empty_like(n)
    out[by_y] = n
    return out


def nearest(df: DataFrame, targets: DataFrame, key: str, target: str, x: str, y: str, size: float, within: str) -> DataFrame:
    """(key, target, distance): of each row the nearest target of its group, of equals the smaller one.

    Rings of grid cells are searched outwards, four times as wide each time, for the rows that have no target closer than the ring
    guarantees; so a row meets the targets around it only, and one far from all meets a few coarse cells. The first ring is ``size`` wide, or
    less where targets lie denser than a few in that. Targets at one place are one, the smallest. A cell's rows meet the targets around it as arrays, of which
    only the nearest leave the task. Rows and targets with a null group, key or coordinate take no part, and a group without targets gives no
    rows; a repeated key is one row, nearest wins. Each ring is saved."""
    rows = df.select(within, F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")).toDF("g", "k", "x", "y").dropna()
    goals = targets.select(within, F.col(target).alias("t"), F.col(x).alias("tx"), F.col(y).alias("ty")).toDF("g", "t", "tx", "ty").dropna()
    work, out = Workspace(df.sparkSession, "nearest"), None
    goals = work.save(goals.groupBy("g", "tx", "ty").agg(F.min("t").alias("t")))
    reach = goals.agg(F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    span = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if reach[0] is None or span[0] is None:
        return df.limit(0).select(key, F.lit(None).cast(targets.schema[target].dataType).alias(target), F.lit(0.0).alias("distance"))
    widest = max(reach[1], span[1]) - min(reach[0], span[0]) + max(reach[3], span[3]) - min(reach[2], span[2]) + size
    most = goals.groupBy("g").count().agg(F.max("count")).first()[0]
    dense = ((reach[1] - reach[0]) * (reach[3] - reach[2]) * FEW / most) ** 0.5
    size = min(size, dense) if dense > size / 1024 else size
    while True:
        met = _met(rows, goals, size, (rows.schema["k"].dataType, goals.schema["t"].dataType))
        d2 = (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2
        best = F.min(F.struct(F.round(d2, 9).alias("d2"), "t")).alias("b")
        found = met.groupBy("k").agg(best).select("k", F.col("b.t").alias("t"), F.sqrt("b.d2").alias("d"))
        last = size > widest
        ring = work.save(found if last else found.where(F.col("d") <= size * (1 - 1e-9)))  # what follows reads this ring instead of redoing all before it
        out = ring if out is None else out.unionByName(ring)
        left = rows.join(ring.select("k"), "k", "left_anti")
        if last or left.isEmpty():
            return out.toDF(key, target, "distance")
        rows = work.save(left)
        size *= 4


def _met(rows: DataFrame, goals: DataFrame, size: float, kinds: tuple[T.DataType, T.DataType]) -> DataFrame:
    """(k, x, y, t, tx, ty) of rows (g, k, x, y) and the targets in the nine cells around each: the nearest, and what is about as near."""
    cells = ["g", "gx", "gy"]

    def packed(at: DataFrame, columns: list[str]) -> DataFrame:
        parts = at.groupBy(*cells).agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")).where("parts > 1")
        part = F.pmod(F.xxhash64(*columns), F.coalesce("parts", F.lit(1))).alias("part")
        dealt = at.join(parts, cells, "left").select(*cells, part, F.struct(*columns).alias("s"))
        return dealt.groupBy(*cells, "part").agg(F.collect_list("s").alias(f"of_{columns[0]}")).drop("part")

    around = goals.select("g", "t", "tx", "ty", _around(_cell("tx", size)).alias("gx"), _cell("ty", size).alias("gy"))
    around = around.select("g", "t", "tx", "ty", "gx", _around(F.col("gy")).alias("gy"))
    placed = rows.select("g", "k", "x", "y", _cell("x", size).alias("gx"), _cell("y", size).alias("gy"))
    both = packed(placed, ["k", "x", "y"]).join(packed(around, ["t", "tx", "ty"]).hint("merge"), cells).select("of_k", "of_t")
    double = T.DoubleType()
    names = {"k": kinds[0], "x": double, "y": double, "t": kinds[1], "tx": double, "ty": double}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                mine, them = batch.column("of_k")[i].values, batch.column("of_t")[i].values
                x, y, tx, ty = (part.field(c).to_numpy(zero_copy_only=False).astype(float) for part, c in ((mine, "x"), (mine, "y"), (them, "tx"), (them, "ty")))
                for low in range(0, len(x), 256):
                    d2 = (x[low : low + 256, None] - tx[None, :]) ** 2 + (y[low : low + 256, None] - ty[None, :]) ** 2
                    p, q = np.nonzero(d2 <= d2.min(axis=1, keepdims=True) * (1 + 1e-12) + 2e-9)
                    one, two = mine.take(pa.array(p + low)), them.take(pa.array(q))
                    columns = [one.field("k"), pa.array(x[p + low]), pa.array(y[p + low]), two.field("t"), pa.array(tx[q]), pa.array(ty[q])]
                    yield pa.RecordBatch.from_arrays(columns, list(names))

    return map_arrow(both, run, T.StructType([T.StructField(n, t) for n, t in names.items()]))


def spread_out(df: DataFrame, key: str, x: str, y: str, value: str, apart: float, most: int, within: str) -> DataFrame:
    """Greedy non-maximum suppression: per group up to ``most`` rows of the largest values, any two over ``apart`` from each other.

    Each round takes every group's best row by an aggregate and drops what lies too near; of equals the larger key goes first."""
    rows, picked = df.select(within, key, x, y, value), None
    for number in range(most):
        best = rows.groupBy(within).agg(F.max(F.struct(value, key, x, y)).alias("b"))
        best = best.select(within, F.lit(number + 1).cast("long").alias("pick"), F.col(f"b.{key}").alias(key), F.col(f"b.{x}").alias("bx"), F.col(f"b.{y}").alias("by"), F.col(f"b.{value}").alias(value))
        picked = best if picked is None else picked.unionByName(best)
        if number + 1 < most:
            far = (F.col(x) - F.col("bx")) ** 2 + (F.col(y) - F.col("by")) ** 2 > apart * apart
            rows = rows.join(best.select(within, "bx", "by"), within).where(far).select(within, key, x, y, value)
    return picked.select(within, "pick", key, F.col("bx").alias(x), F.col("by").alias(y), value)


def boxes(picked: DataFrame, x: str, y: str, half: float) -> DataFrame:
    """Half-open crop windows around picked rows."""
    return picked.withColumns({"x0": F.col(x) - half, "y0": F.col(y) - half, "x1": F.col(x) + half, "y1": F.col(y) + half})


def count_in_boxes(windows: DataFrame, df: DataFrame, x: str, y: str, within: str, name: str) -> DataFrame:
    """How many rows of its group lie in each window; there are a few windows a group."""
    px, py = free_name("point_x", windows), free_name("point_y", windows)
    inside = df.select(within, F.col(x).alias(px), F.col(y).alias(py)).join(windows, within)
    inside = inside.where((F.col(px) >= F.col("x0")) & (F.col(px) < F.col("x1")) & (F.col(py) >= F.col("y0")) & (F.col(py) < F.col("y1")))
    return windows.join(inside.groupBy(within, "pick").agg(F.count("*").alias(name)), [within, "pick"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
