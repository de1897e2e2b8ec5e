"""Whitening of embeddings by principal components of a compensated covariance.

The covariance is summed in double-double numbers, pairs of a double and what it lacks. Centred vectors, pairs too, are cut into slices of so few
bits, on one scale for a block of rows, that a matrix product of two slices has no rounding at all (an error-free transformation of the product); the
exact products are then added with what each addition loses. Tasks send sums in strips of rows, high and low parts, and strips are merged in executors
the same way; the sum is rounded once. The eigenvectors are those of LAPACK's tridiagonal divide and conquer, which is what numpy's ``eigh`` calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import Workspace, integer_id, map_arrow

#: A component becomes floor(SCALE * c) + SHIFT, a whole number.
SCALE, SHIFT = 64, 1_000_000
#: Rows of one exact product: 8 bits of 53; two slices of 22 bits take the others.
ROWS, BITS, SLICES = 256, 22, 5
#: Rows of a matrix that are sent and added at once.
STRIP = 64
#: Longer vectors are an error: the matrix of their products is solved on the driver.
MOST_DIMENSIONS = 4096


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): whole numbers of each vector; rows whose vector is null or empty or holds null or non-finite components are left out."""
    v = df[vector].cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(integer_id(df, key).alias("key"), v.alias("v"), bad.alias("bad")).where(~F.col("bad") & (F.size("v") > 0))
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(2.0**61)), F.lit(-(2.0**61)))  # noqa: E731  far beyond what ``fit`` takes
    return rows.select("key", F.transform("v", lambda c: F.floor(held(c)).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and what it lacks, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) + (more, rest) in double-double."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, np.broadcast_to(rest, low.shape))
    s, e = _fast(s, e + t)
    return _fast(s, e + f)


def _fast(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    return s, b - (s - a)


def slices(d: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """``d`` + ``rest`` as ``SLICES`` matrices of at most ``BITS`` bits on one scale, 110 bits below the largest entry: the sum of ``ROWS``
    products of two slices' entries is exact."""
    unit, out = 2.0 ** (np.frexp(float(np.abs(d).max(initial=0.0)))[1] - BITS), []
    for _ in range(SLICES):
        part = np.rint(d / unit) * unit
        out.append(part)
        d, rest = two_sum(d - part, rest)
        unit /= 2**BITS
    return out


def outer(high: np.ndarray, low: np.ndarray, d: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) with the outer products of the rows of ``d`` + ``rest`` added."""
    for i in range(0, len(d), ROWS):
        parts = slices(d[i : i + ROWS], rest[i : i + ROWS])
        for s in range(2 * SLICES - 2, -1, -1):  # small ones first
            for a in range(max(0, s - SLICES + 1), s // 2 + 1):
                product = parts[a].T @ parts[s - a]
                high, low = add(high, low, product)
                if a != s - a:
                    high, low = add(high, low, product.T)
    return high, low


def centred(x: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x - total / n of whole numbers, as doubles and what these lack."""
    top = n * x - total  # exact
    d = top / n
    whole = np.rint(d).astype(np.int64)  # d = whole + part; n * part is small
    part = d - whole
    a = np.float64(n) * 134217729.0
    n_high = a - (a - n)
    b = part * 134217729.0
    p_high = b - (b - part)
    product = n * part
    error = ((n_high * p_high - product) + n_high * (part - p_high) + (n - n_high) * p_high) + (n - n_high) * (part - p_high)
    return d, (((top - n * whole).astype(np.float64) - product) - error) / n


def _strips(matrices: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    starts = range(0, len(matrices[0]), STRIP)
    columns = [pa.array([m[i : i + STRIP].tobytes() for i in starts], pa.binary()) for m in matrices]
    return pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), *columns], ["strip", "high", "low"])


def _merge(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    high = low = None
    for batch in group:
        for a, b in zip(batch.column("high"), batch.column("low"), strict=True):
            a, b = np.frombuffer(a.as_buffer()), np.frombuffer(b.as_buffer())
            high, low = (a.copy(), b.copy()) if high is None else add(high, low, a, b)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([high.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary())], ["strip", "high", "low"])


def covariance(rows: DataFrame, n: int, total: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """The covariance, divisor n, of rows (x) with these sums; of their coordinates in ``onto``'s columns, if given."""
    size = len(total) if onto is None else onto.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, seen = np.zeros((size, size)), np.zeros((size, size)), False
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                d, rest = centred(_matrix(batch.column("x").slice(i, ROWS)), n, total)
                if onto is not None:
                    d = d @ onto + rest @ onto
                    rest = np.zeros_like(d)
                high, low = outer(high, low, d, rest)
                seen = True
        if seen:
            yield _strips((high, low))

    sums = map_arrow(rows.select("x"), run, "strip int, high binary, low binary").groupBy("strip").applyInArrow(_merge, "strip int, high binary, low binary")
    found = sorted((r.strip, r.high, r.low) for r in sums.collect())
    high, low = (np.concatenate([np.frombuffer(r[i]) for r in found]).reshape(size, size) for i in (1, 2))
    return (high + low) / n


def fit(rows: DataFrame, most: int = 16, work: Workspace | None = None) -> dict | None:
    """The fit on each distinct x of ``quantised`` rows once: n, the sums of x by dimension, ``most`` unit eigenvectors of the covariance as columns, their
    eigenvalues from the largest on, the shares of the trace, and identity_error, the largest entry of the whitened rows' covariance less the identity.

    None if there are no rows. Components without variance (up to rounding) can't be whitened and are left out, so there are none if all rows are one
    vector. Vectors of different lengths or of over ``MOST_DIMENSIONS`` dimensions, and components whose sums pass 62 bits, are an error."""
    work = work or Workspace(rows.sparkSession, "whitening")
    size, large = F.size("x"), F.greatest(F.array_max("x"), -F.array_min("x"))
    least, longest, most_x = rows.agg(F.min(size), F.max(size), F.max(large)).first()
    if least is None:
        return None
    if least != longest or longest > MOST_DIMENSIONS:
        raise ValueError(f"vectors must be of one length of at most {MOST_DIMENSIONS}, not {least} to {longest}")
    distinct = work.save(rows.select("x").distinct())
    n = distinct.count()
    if n * most_x >= 2**62:
        raise ValueError(f"components are too large for exact sums of {n} rows")
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).collect()
    total = np.zeros(longest, np.int64)
    for r in sums:
        total[r.i] = r.s
    v = covariance(distinct, n, total)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    keep = values > max(values.max(initial=0.0), 0.0) * longest * np.finfo(float).eps
    values, vectors = values[keep], vectors[:, keep]
    trace = float(np.trace(v))
    out = {"n": n, "total": total, "values": values, "vectors": vectors, "explained": values / trace if trace > 0 else values, "identity_error": 0.0}
    if len(values):
        out["identity_error"] = float(np.abs(covariance(distinct, n, total, vectors / np.sqrt(values)) - np.eye(len(values))).max())
    return out


def _deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int]:
    """The sum over dimensions of (n x - total)^2 of each row, exactly: in 64 bits where they are enough, else in Python's whole numbers."""
    top = n * x - total
    most = int(np.abs(top).max(initial=0))
    if most * most * top.shape[1] < 2**63:
        return (top * top).sum(1).tolist()
    return [sum(v * v for v in row) for row in top.tolist()]


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error), a row for each usable row: the size of the fit list, the sum over dimensions of
    (n x - S)^2 as a whole number, and arrays of coordinates and of shares of the variance by component.

    The components are broadcast, dimensions times ``most`` numbers. Null keys stay null; rows that repeat a vector have the same coordinates and
    count once in the fit; a table without usable rows gives none; other columns are not read, whatever their names."""
    work = Workspace(df.sparkSession, "whitening")
    rows = quantised(df, key, vector)
    model = fit(rows, most, work)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType())), T.StructField("identity_error", T.DoubleType())])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        onto, n, k = m["vectors"] / np.sqrt(m["values"]), m["n"], len(m["values"])
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                x = _matrix(part.column("x"))
                d, rest = centred(x, n, m["total"])
                y = d @ onto + rest @ onto
                lists = pa.FixedSizeListArray.from_arrays(pa.array(y.reshape(-1)), k).cast(pa.list_(pa.float64())) if k else pa.array([[]] * len(part), pa.list_(pa.float64()))
                fixed = lambda v, kind: pa.array([v] * len(part), kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), fixed(n, pa.int64()), pa.array(_deviations(x, n, m["total"])).cast(pa.decimal128(38, 0)), lists, fixed(m["explained"].tolist(), pa.list_(pa.float64())), fixed(m["identity_error"], pa.float64())],
                    schema.names,
                )

    return map_arrow(rows, run, schema)


def by_component(white: DataFrame) -> DataFrame:
    """``whitened``'s rows as one for each component, numbered from 1: (key, component, n, deviation, whitened, explained, identity_error)."""
    rows = white.select("key", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("i", "whitened"))
    return rows.select("key", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("i") + 1).alias("explained"), "identity_error")
