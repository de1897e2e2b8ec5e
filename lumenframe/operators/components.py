"""Principal components without the matrix of all dimensions by all dimensions: mergeable partial fits, and a random range finder.

A partial fit holds the number of rows, their mean, their sums of squares about it by dimension, and the leading singular vectors times singular values. Two
of them merge into one: the stacked vectors and the difference of the means have the singular vectors of all rows together, as far as each
kept them. Tasks fit their rows batch by batch, and their fits are merged in executors a few at a time, so that what reaches the driver is one fit
of the size of the model. The same merge takes in the rows of a later micro-batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_arrow
from ..functions.storage import Workspace
from .vectors import _usable

#: Fits that one task merges.
FAN = 16
#: Singular vectors that a fit keeps at least: each merge loses what it doesn't keep, which in a flat spectrum is much of the leading directions.
KEPT = 128
#: Rows of a matrix that are sent and added at once.
STRIP = 256


@dataclass
class Fit:
    """n rows; mean and sums of squares about it, by dimension; rows of singular vectors times singular values, the largest first."""

    n: int
    mean: np.ndarray
    squares: np.ndarray
    axes: np.ndarray

    def packed(self) -> bytes:
        return np.concatenate([[self.n, len(self.axes)], self.mean, self.squares, self.axes.reshape(-1)]).astype(np.float64).tobytes()

    @staticmethod
    def of(blob: bytes | memoryview | pa.Buffer) -> Fit:
        x = np.frombuffer(blob)
        n, k = int(x[0]), int(x[1])
        d = (len(x) - 2) // (2 + k)
        return Fit(n, x[2 : 2 + d], x[2 + d : 2 + 2 * d], x[2 + 2 * d :].reshape(k, d))

    def components(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean, components by rows, share of variance), the largest loading of each positive; k is held to max(2, min(k, dimensions - 1,
        rows - 1)) and to what was kept."""
        k = max(2, min(k, len(self.mean) - 1, self.n - 1))
        length = np.sqrt((self.axes * self.axes).sum(1))
        keep = np.flatnonzero(length > 0)[:k]
        parts = self.axes[keep] / length[keep, None]
        signs = np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)]) if len(parts) else np.ones(0)
        total = self.squares.sum()
        return self.mean, parts * signs[:, None], length[keep] ** 2 / total if total > 0 else np.zeros(len(keep))


def _axes(rows: np.ndarray, kept: int) -> np.ndarray:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:kept, None] * v[:kept]


def fitted(x: np.ndarray, kept: int) -> Fit:
    """Of the rows of a matrix."""
    mean = x.mean(axis=0)
    centred = x - mean
    return Fit(len(x), mean, (centred * centred).sum(0), _axes(centred, kept))


def merged(a: Fit, b: Fit, kept: int) -> Fit:
    """Of the rows of both."""
    n, gap = a.n + b.n, b.mean - a.mean
    weight = a.n * b.n / n
    axes = _axes(np.vstack([a.axes, b.axes, math.sqrt(weight) * gap]), kept)
    return Fit(n, a.mean + gap * (b.n / n), a.squares + b.squares + weight * gap * gap, axes)


def batches(n: int, size: int, least: int) -> list[tuple[int, int]]:
    """Where batches of ``size`` rows begin and end; a last one of fewer than ``least`` rows joins the one before it."""
    ends = list(range(size, n, size))
    if ends and n - ends[-1] < least:
        ends.pop()
    return list(zip([0, *ends], [*ends, n], strict=True)) if n else []


def _matrices(batches_: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[np.ndarray]:
    """A task's vectors as matrices of ``size`` rows; a last one of fewer than ``least`` rows comes with the one before it."""
    held: list[np.ndarray] = []
    for batch in batches_:
        if len(batch):
            held.append(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
        while sum(map(len, held)) >= 2 * size:
            x = np.concatenate(held)
            yield x[:size]
            held = [x[size:]]
    x = np.concatenate(held) if held else np.zeros((0, 0))
    for low, high in batches(len(x), size, least):
        yield x[low:high]


def _rows(df: DataFrame, vector: str) -> DataFrame:
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where(_usable("v"))
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least is None:
        raise ValueError("no rows to fit")
    if least != most:
        raise ValueError(f"vectors differ in length: {least} to {most}")
    return rows


def incremental_fit(df: DataFrame, vector: str, k: int, batch: int = 4096, before: Fit | None = None) -> Fit:
    """A ``Fit`` that keeps 2 k singular vectors, ``KEPT`` at least, of ``df``'s vectors and, if given, of what was fitted ``before``.

    Batches have ``batch`` rows, as many as are kept at least; a task's last batch of fewer than k joins the one before it. Vectors that are null or empty or hold
    null or non-finite components are left out; a table without others, or with vectors of different lengths, is an error."""
    kept = max(2 * k, KEPT)
    size = max(batch, kept)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = None
        for x in _matrices(batches_, size, k):
            new = fitted(x, kept)
            fit = new if fit is None else merged(fit, new, kept)
        if fit is not None:
            yield pa.RecordBatch.from_arrays([pa.array([fit.packed()], pa.binary())], ["fit"])

    def join(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = None
        for b in group:
            for blob in b.column("fit"):
                new = Fit.of(blob.as_buffer())
                fit = new if fit is None else merged(fit, new, kept)
        yield pa.RecordBatch.from_arrays([pa.array([fit.packed()], pa.binary())], ["fit"])

    work = Workspace(df.sparkSession, "fits")
    fits = work.save(map_arrow(_rows(df, vector), run, "fit binary"))
    while (n := fits.count()) > 1:
        groups = -(-n // FAN)
        dealt = fits.withColumn("group", F.pmod(F.xxhash64("fit"), F.lit(groups)))
        last, fits = fits, work.save(dealt.groupBy("group").applyInArrow(join, "fit binary"))
        work.drop(last)
    fit = Fit.of(fits.first()[0])
    return fit if before is None else merged(before, fit, kept)


def _product(rows: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """X' X times ``basis`` for the centred rows X, dimensions by columns: strips are added by key in the executors."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, basis))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, q = shared.value
        total = None
        for x in _matrices(batches_, 4096, 1):
            x = x - centre
            part = x.T @ (x @ q)
            total = part if total is None else total + part
        if total is not None:
            starts = range(0, len(total), STRIP)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[i : i + STRIP].tobytes() for i in starts], pa.binary())], ["strip", "m"])

    def add(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in group:
            for blob in b.column("m"):
                m = np.frombuffer(blob.as_buffer())
                total = m.copy() if total is None else total + m
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["strip", "m"])

    found = sorted((r["strip"], r["m"]) for r in map_arrow(rows, run, "strip int, m binary").groupBy("strip").applyInArrow(add, "strip int, m binary").collect())
    return np.concatenate([np.frombuffer(m) for _, m in found]).reshape(len(mean), -1)


def _triangle(rows: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of the centred rows times ``basis``: each task's blocks leave a triangle, and triangles are stacked and decomposed
    again, a few at a time."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, basis))
    width = basis.shape[1]

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, q = shared.value
        r = np.zeros((0, width))
        for x in _matrices(batches_, 4096, 1):
            r = np.linalg.qr(np.vstack([r, (x - centre) @ q]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def join(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in group:
            for blob in b.column("r"):
                r = np.linalg.qr(np.vstack([r, np.frombuffer(blob.as_buffer()).reshape(-1, width)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    work = Workspace(rows.sparkSession, "triangles")
    triangles = work.save(map_arrow(rows, run, "r binary"))
    while (n := triangles.count()) > 1:
        dealt = triangles.withColumn("group", F.pmod(F.xxhash64("r"), F.lit(-(-n // FAN))))
        last, triangles = triangles, work.save(dealt.groupBy("group").applyInArrow(join, "r binary"))
        work.drop(last)
    return np.frombuffer(triangles.first()[0]).reshape(-1, width)


def randomised_components(df: DataFrame, vector: str, k: int, over: int = 10, power: int = 7, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components by rows, share of variance): k directions that hold nearly the most variance, the largest loading of each positive.

    A random basis of k + ``over`` directions goes ``power`` + 1 times through X' X; what it was on the way spans a block Krylov space, which holds the leading
    directions of a flat spectrum too, and the rows in its coordinates are decomposed by blocks. The driver holds dimensions times (k + ``over``) *
    (``power`` + 2) numbers at most. Odd vectors and k are treated as in ``principal_components``."""
    rows = _rows(df, vector)
    sums = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"), F.count("*").alias("n")).collect()
    n, d = sums[0]["n"], len(sums)
    mean, variance = np.zeros(d), 0.0
    for r in sums:
        mean[r["d"]] = r["m"]
        variance += r["s"]
    k = max(2, min(k, d - 1, n - 1))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + over))))[0]
    passed = [basis]
    for _ in range(power + 1):
        passed.append(np.linalg.qr(_product(rows, mean, passed[-1]))[0])
    basis = np.linalg.qr(np.hstack(passed[::-1]))[0]
    _, s, w = np.linalg.svd(_triangle(rows, mean, basis), full_matrices=False)
    parts = (w @ basis.T)[:k]
    signs = np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])
    total = variance * n
    return mean, parts * signs[:, None], s[:k] ** 2 / total if total > 0 else np.zeros(len(parts))
