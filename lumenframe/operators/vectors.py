"""Embeddings as array columns: normalisation, variances, exact nearest neighbours in blocks, principal components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..functions.arrow import map_arrow
from ..functions.storage import Workspace, free_name

#: Rows of a block, and its numbers at most; a block against a block is one matrix product.
BLOCK, BLOCK_NUMBERS = 2048, 1 << 18
#: Blocks of one side that meet in one task.
CELL = 32
#: Numbers of candidates that are held at once.
HELD = 1 << 22
#: More than a distance that is rounded to nine digits may differ from itself.
SLACK = 2e-9
#: Rows of a moment matrix that are sent and added at once.
STRIP = 64


def normalised_with_checks(df: DataFrame, vector: str) -> DataFrame:
    """``vector`` at length 1 (zero rows stay zero), and n_bad (non-finite components), zero_norm and zero_variance of each row."""
    clean = S.finite(F.col(vector))
    bad = F.size(F.filter(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    same = F.array_min(clean) == F.array_max(clean)
    return df.withColumns({"n_bad": bad.cast("long"), "zero_norm": S.norm(clean) <= 1e-12, "zero_variance": F.coalesce(same, F.lit(True)), vector: S.l2_normalised(F.col(vector))})


def dimension_variances(df: DataFrame, vector: str) -> DataFrame:
    """(dim, variance): population variances over rows, dimensions from 0; partial sums by dimension."""
    return df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))


def top_dimensions(variances: DataFrame, k: int) -> DataFrame:
    """The k most variable dimensions in order; of equals the higher one first."""
    order = Window.orderBy(F.desc("variance"), F.desc("dim"))
    return variances.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def reordered(df: DataFrame, vector: str, dims: list[int]) -> DataFrame:
    at = F.array(*(F.lit(d) for d in dims))
    return df.withColumn(vector, F.transform(at, lambda i: F.element_at(F.col(vector), i + 1)))


def _usable(vector: str) -> F.Column:
    """True for vectors of finite components only, at least one."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _blocks(rows: DataFrame) -> DataFrame:
    """(g, width, ids, vectors) of rows (g, id, v): blocks of at most ``BLOCK`` rows and ``BLOCK_NUMBERS`` numbers of one group and one length."""
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("width", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.array([g or "" for g in batch.column("g").to_pylist()], object)
            ids = batch.column("id").to_numpy()
            lists = batch.column("v")
            width = lists.value_lengths().to_numpy()
            values, start = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(width) - width
            for name, size in sorted(set(zip(group.tolist(), width.tolist(), strict=True))):
                mine = np.flatnonzero((group == name) & (width == size))
                mine = mine[np.argsort(ids[mine], kind="stable")]
                step = max(1, min(BLOCK, BLOCK_NUMBERS // size))
                for low in range(0, len(mine), step):
                    part = mine[low : low + step]
                    x = values[start[part][:, None] + np.arange(size)]
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(size)]), pa.array([ids[part].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], schema.names)

    return map_arrow(rows, run, schema)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _of_pairs(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows i of q and j of x, each pair by itself, so that they don't depend on what they are computed with."""
    out = np.empty(len(i))
    a, b = _lengths(q), _lengths(x)
    step = max(1, HELD // q.shape[1])
    for low in range(0, len(i), step):
        at, to = i[low : low + step], j[low : low + step]
        if metric == "cosine":
            near, lengths = np.einsum("nd,nd->n", q[at], x[to]), a[at] * b[to]
            out[low : low + step] = 1 - np.divide(near, lengths, out=np.zeros_like(near), where=lengths > 0)
        else:
            gap = q[at] - x[to]
            out[low : low + step] = np.sqrt(np.einsum("nd,nd->n", gap, gap))
    return out


def _rough(q: np.ndarray, x: np.ndarray, metric: str, far: float) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]] | None:
    """One matrix product that orders each row of q's distances to x, how a value of it bounds a distance from above, and which values a pair
    of at most a distance may have; None where numbers are too large or small for that.

    It is made in single precision where the rounding, which the bounds allow for, is little beside a usual distance ``far`` of what is asked for."""
    a, b = _lengths(q), _lengths(x)
    known = np.concatenate([a[a > 0], b[b > 0]])
    if len(known) and not (known.min() > 1e-140 and known.max() < 1e140):
        return None
    kind, rounding = np.float64, lambda kind: 8 * (q.shape[1] + 4) * np.finfo(kind).eps
    scale = 1.0 if metric == "cosine" else (a * a).max(initial=0.0) + (b * b).max(initial=0.0)
    least = far if metric == "cosine" else far * far
    if len(known) and known.min() > 1e-12 and known.max() < 1e12 and np.isfinite(far) and rounding(np.float32) * scale <= 0.01 * least:
        kind = np.float32
    up = lambda s: s if kind is np.float64 else np.nextafter(s.astype(kind), np.float32(np.inf))
    if metric == "cosine":
        unit = lambda v, length: np.divide(v, length[:, None], out=np.zeros_like(v), where=length[:, None] > 0).astype(kind)
        error = 0.0 if kind is np.float64 else rounding(kind)
        return unit(-q, a) @ unit(x, b).T, lambda s: 1 + s.astype(float) + error, lambda d: up(d - 1 + SLACK + error)
    error = rounding(kind) * (a * a + (b * b).max())
    product = (-2 * q).astype(kind) @ x.astype(kind).T
    product += (b * b).astype(kind)
    return product, lambda s: np.sqrt(np.maximum(s + a * a + error, 0)), lambda d: up((d + SLACK) ** 2 - a * a + error)


def _in_order(i: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """np.lexsort((ids, distance, i)) for few distinct i and distances that are mostly distinct."""
    order = np.argsort(distance)
    same = distance[order[1:]] == distance[order[:-1]]
    if same.any():
        tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
        at = order[tied]
        order[tied] = at[np.lexsort((ids[at], distance[at]))]
    small = i.astype(np.int16) if i.max(initial=0) < 1 << 15 else i
    return order[np.argsort(small[order], kind="stable")]


class _Best:
    """The k nearest that some queries have met so far: places of queries, keys and distances, of equals the smaller key."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.found, self.size = n, k, [], 0
        self.worst = np.full(n, np.inf)

    def add(self, i: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        ok = np.isfinite(distance)
        self.found.append((i[ok], ids[ok], distance[ok]))
        self.size += int(ok.sum())
        if len(self.found) == 1 or self.size > 2 * self.n * self.k:
            self.kept()

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, ids, distance = (np.concatenate(c) for c in zip(*self.found, strict=True)) if self.found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = _in_order(i, np.round(distance, 9), ids)
        first = np.searchsorted(i[order], np.arange(self.n + 1))
        rank = np.arange(len(order)) - first[i[order]]
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.found, self.size = [(i[order], ids[order], distance[order])], len(order)
        last = order[rank == self.k - 1]
        self.worst[i[last]] = distance[last]
        return self.found[0]


def _met(best: _Best, asked: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, metric: str) -> None:
    """A block of queries meets a block of rows: the pairs that may enter a list are picked by one matrix product, and only their distances
    are computed one by one."""
    same = np.isin(asked, ids)
    rough = _rough(q, x, metric, float(np.median(best.worst)) if len(q) else np.inf)
    if rough is None:
        i, j = (c.reshape(-1) for c in np.indices((len(q), len(x))))
    else:
        score, above, bound = rough
        if same.any():
            own = np.flatnonzero(same)
            score[own] = np.where(asked[own, None] == ids[None, :], np.inf, score[own])
        worst = best.worst
        if not best.found and best.k < len(ids):
            # rows in which the k-th is no other row keep an infinite bound
            worst = above(np.partition(score, best.k - 1, axis=1)[:, best.k - 1])
        i, j = np.divmod(np.flatnonzero(score <= bound(worst)[:, None]), len(ids))
    apart = asked[i] != ids[j]
    i, j = i[apart], j[apart]
    best.add(i, ids[j], _of_pairs(q, x, i, j, metric))


def exact_neighbours(df: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", within: str | None = None) -> DataFrame:
    """(src, dst, rank, distance): the k nearest other rows of each, of equals the smaller key; ``within`` keeps to one group. The table is
    saved, so what reads it several times doesn't search again.

    All rows are asked against all rows, so the work is quadratic: one matrix product for each two blocks of rows, of which only the
    pairs that may enter a list are looked at again. Blocks are numbered and dealt to cells by salts - every salt of one side meets every salt of the
    other once - with at most ``CELL`` blocks of either side in a cell, so a cell's memory is bounded and a group's work spreads over all tasks. What
    leaves a cell is one row of packed lists for each block of queries; these are merged block by block. metric: cosine or euclidean distance.

    Rows with a null key, or a vector that is null or empty or holds null or non-finite components, take no part; vectors of different
    lengths are no neighbours; a zero vector is at cosine distance 1 of all. Rows that repeat a key are no neighbours of each other, and
    share one rank. An empty table gives no rows."""
    spark = df.sparkSession
    g = F.lit("") if within is None else F.coalesce(F.col(within).cast("string"), F.lit(""))
    rows = df.select(g.alias("g"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(_usable("v") & F.col("id").isNotNull())
    work = Workspace(spark, "neighbours")
    blocks = work.save(_blocks(rows).withColumn("b", F.monotonically_increasing_id()))
    group = Window.partitionBy("g", "width")
    least = max(1, math.isqrt(12 * spark.sparkContext.defaultParallelism))
    salts = F.least(F.col("many"), F.greatest(F.lit(least), F.ceil(F.col("many") / CELL))).cast("int")
    places = blocks.select("g", "width", "b").withColumn("many", F.count("*").over(group)).withColumn("salts", salts)  # one short row for each block
    places = work.save(places.withColumn("salt", (F.row_number().over(group.orderBy("b")) % F.col("salts")).cast("int")).select("b", "salts", "salt"))
    cells = max(1, blocks.join(places, "b").groupBy("g", "width").agg(F.max("salts").cast("long").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0)
    dealt = blocks.join(places, "b").withColumn("every", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    names = ["g", "width", "s", "t", "b", "ids", "vectors"]
    sides = {name: dealt.select("g", "width", s, t, "b", "ids", "vectors").toDF(*(f"{name}{c}" for c in names)) for name, s, t in (("x_", "salt", "every"), ("q_", "every", "salt"))}
    mine, other = (side.repartition(min(cells, 2000), *side.columns[:4]).groupBy(*side.columns[:4]) for side in sides.values())

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, queries: pa.Table) -> pa.Table:
        width = key[1].as_py()
        unpacked = lambda t: [(b, np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(v.as_buffer()).reshape(-1, width)) for b, i, v in zip(*t.columns[4:], strict=True)]
        them, out = unpacked(rows), []
        for b, asked, q in unpacked(queries):
            best = _Best(len(asked), k)
            for _, ids, x in them:
                _met(best, asked, q, ids, x, metric)
            out.append((b.as_py(), asked.tobytes(), *(c.tobytes() for c in best.kept())))
        return pa.table([pa.array(c, pa.int64() if n == 0 else pa.binary()) for n, c in enumerate(zip(*out, strict=True))] if out else [[]] * 5, ["b", "asked", "i", "dst", "distance"])

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for part in parts:
            for asked, i, dst, distance in zip(*(part.column(c) for c in ("asked", "i", "dst", "distance")), strict=True):
                src = np.frombuffer(asked.as_buffer(), np.int64)
                best = best or _Best(len(src), k)
                best.add(np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(dst.as_buffer(), np.int64), np.frombuffer(distance.as_buffer()))
        i, dst, distance = best.kept()
        yield pa.RecordBatch.from_arrays([pa.array(src[i]), pa.array(dst), pa.array(distance)], ["src", "dst", "distance"])

    lists = mine.cogroup(other).applyInArrow(run, "b long, asked binary, i binary, dst binary, distance binary")
    found = lists.groupBy("b").applyInArrow(merge, "src long, dst long, distance double")
    order = Window.partitionBy("src").orderBy(F.round("distance", 9), "dst")  # rows that repeat a key may lie in several blocks
    out = work.save(found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("src", "dst", "rank", "distance"))
    work.drop(blocks, places)
    return out


def sample_effect(edges: DataFrame, samples: DataFrame, key: str, sample: str) -> DataFrame:
    """One row: share of neighbours from the same sample, what it would be by chance (sum of squared shares), their difference and ratio."""
    s = samples.select(F.col(key).alias("src"), F.col(sample).alias("a"))
    d = samples.select(F.col(key).alias("dst"), F.col(sample).alias("b"))
    observed = edges.join(s, "src").join(d, "dst").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("observed"))
    sizes = samples.groupBy(sample).agg(F.count("*").cast("double").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    expected = sizes.select((p * p).alias("pp")).agg(F.sum("pp").alias("expected"))
    parts = observed.unionByName(expected, allowMissingColumns=True)
    one = parts.agg(F.max("observed").alias("observed"), F.max("expected").alias("expected"))
    r = lambda c: F.round(c, 6)
    return one.select(r("observed").alias("observed"), r("expected").alias("expected"), r(F.col("observed") - F.col("expected")).alias("excess"), r(F.col("observed") / F.col("expected")).alias("ratio"))


def sampled_effect(df: DataFrame, key: str, vector: str, sample: str, most: int, k: int = 30, seed: int = 17) -> DataFrame:
    """``sample_effect`` of at most ``most`` rows, those of the smallest hashed keys: what the diagnosis before and after a correction is
    made on. One row, with n_subsample."""
    rows = df.select(key, vector, sample).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)
    rows = Workspace(df.sparkSession, "effect").save(rows)
    n = rows.count()
    effect = sample_effect(exact_neighbours(rows, key, vector, max(1, min(k, n - 1))), rows, key, sample)
    return effect.withColumn("n_subsample", F.lit(n).cast("long"))


def _moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and second-moment matrix over usable vectors.

    Each task adds up its rows and sends its matrix in strips of rows; strips are added by key in the executors, so the driver gets one
    matrix, of dimensions squared, however many rows and tasks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack([np.asarray(v, np.float64) for v in batch.column("v").to_pylist()])
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            starts = range(0, len(total), STRIP)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[i : i + STRIP].tobytes() for i in starts], pa.binary())], ["strip", "m"])

    def add(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in group:
            for blob in batch.column("m"):
                m = np.frombuffer(blob.as_buffer())
                total = m.copy() if total is None else total + m
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["strip", "m"])

    schema = "strip int, m binary"
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where(_usable("v"))
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"vectors differ in length: {least} to {most}")
    strips = sorted((r["strip"], r["m"]) for r in map_arrow(rows, run, schema).groupBy("strip").applyInArrow(add, schema).collect())
    if not strips:
        raise ValueError("no rows to fit")
    total = np.concatenate([np.frombuffer(m) for _, m in strips])
    size = int(round(len(total) ** 0.5))
    total = total.reshape(size, size)
    n = int(round(total[0, 0]))
    return n, total[0, 1:] / n, total[1:, 1:]


def principal_components(df: DataFrame, vector: str, k: int, centred: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components by rows, share of variance): exact, from the second moments; the largest loading of each is positive.

    k is held to max(2, min(k, dimensions - 1, rows - 1)). Without centring this is the truncated SVD. Vectors that are null or empty or hold
    null or non-finite components are left out; a table without others, or with vectors of different lengths, is an error."""
    n, mean, second = _moments(df, vector)
    if not centred:
        mean = np.zeros_like(mean)
    covariance = (second - n * np.outer(mean, mean)) / max(1, n - 1)
    k = max(2, min(k, len(mean) - 1, n - 1))
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:k]
    parts = vectors[:, order].T
    signs = np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])
    trace = np.trace(covariance)
    return mean, parts * signs[:, None], values[order] / trace if trace > 0 else np.zeros(k)


def project(df: DataFrame, vector: str, mean: np.ndarray, components: np.ndarray, name: str = "scores", normalise: bool = False) -> DataFrame:
    """``df`` with ``name``: the centred vectors' coordinates, null for vectors that can't be used or have another length.

    The components are broadcast, dimensions times k numbers, and a task's vectors are one matrix."""
    shared = df.sparkSession.sparkContext.broadcast((mean, components))
    given = free_name("the_vector", df)
    rows = df.withColumn(given, F.when(_usable(vector) & (F.size(vector) == len(mean)), F.col(vector).cast("array<double>")))
    names = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, parts = shared.value
        for batch in batches:
            column = batch.column(given)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            at = np.full(len(batch), -1)
            at[valid] = np.arange(int(valid.sum()))
            x = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(centre))
            y = (x - centre) @ parts.T
            if normalise:
                y = y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-8)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(y).reshape(-1)), len(parts)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists.take(pa.array(at, mask=~valid))], schema.names)

    return map_arrow(rows, run, schema)
