"""Batch correction by soft clusters, whose rows are assigned again block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.arrow import map_arrow
from ..functions.storage import Workspace

#: Batches that a correction may know, and numbers (clusters x batches x dimensions) that tasks may be sent.
MOST_BATCHES, MOST_NUMBERS = 10_000, 50_000_000


def harmonised(
    df: DataFrame, key: str, vector: str, batch: str, clusters: int | None = None, rounds: int = 10, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0,
    tolerance: float = 1e-3, sample: int = 2000, blocks: int = 3, turns: int = 2, seed: int = 0, history: list[list[float]] | None = None,
) -> DataFrame:
    """(key, vector) with what tells a row's batch apart taken out, at length 1.

    A round clusters the corrected rows and then corrects the original ones. Clustering: in a turn, centres are set to the means of
    their rows; then, for one block of rows after the other (dealt anew by hash every round), the block's statistics are taken out of the totals, its rows
    are assigned softly under the penalty on batches that a cluster has more of than its share, and its new statistics are
    added. A turn that doesn't lower the objective (distances, entropy, and the divergence of batches in clusters) by ``tolerance`` ends the
    clustering, and if it raised it, is undone. Correction: a ridge regression on the batch within each cluster, its intercept free. Rounds end when the
    objective doesn't fall by ``tolerance``; one that raised it is left out. ``history`` receives each kept round's objectives, turn by turn.

    A turn reads every row once, a block's job its own folder only. Tasks send sums by cluster, which are added by key in the executors; the driver gets
    clusters x (batches + dimensions) numbers, and regressions are solved where a cluster's sums meet. Corrected rows are saved once a round, and
    the table before is deleted. clusters: min(round(n / 30), 100) by default, one at least.

    Null batches are a batch of their own. Null vectors are left out, components that are null or not finite count as 0. Over ``MOST_BATCHES``
    batches, or over ``MOST_NUMBERS`` coefficients, are an error. Rows that repeat a key are corrected each; one batch alone is only brought to
    length 1; an empty table stays empty."""
    label = F.coalesce(F.concat(F.lit("b:"), F.col(batch).cast("string")), F.lit("null"))
    names = sorted(r[0] for r in df.select(label.alias("b")).distinct().limit(MOST_BATCHES + 1).collect())
    if len(names) > MOST_BATCHES:
        raise ValueError(f"more than {MOST_BATCHES} batches in {batch}")
    if len(names) < 2:
        return df.withColumn(vector, S.l2_normalised(F.col(vector))).select(key, vector)
    work = Workspace(df.sparkSession, "harmony")
    place = {n: i for i, n in enumerate(names)}
    key_type = df.schema[key].dataType.simpleString()
    schema = f"k {key_type}, b int, v array<double>, x array<double>"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if len(part):
                x = pa.array(list(_unit(np.stack([np.asarray(v, np.float64) for v in part.column("v").to_pylist()]))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([place[b] for b in part.column("b").to_pylist()], pa.int32()), x, x], ["k", "b", "v", "x"])

    def dealt(rows: DataFrame, round_: int) -> DataFrame:
        return work.save(rows.select("k", "b", "v", "x", F.pmod(F.xxhash64("k", F.lit(seed + round_)), F.lit(blocks)).cast("int").alias("block")), by="block")

    rows = df.select(F.col(key).alias("k"), label.alias("b"), S.finite(F.col(vector)).alias("v")).where("v is not null")
    rows = dealt(map_arrow(rows, start, schema), 0)
    n = rows.count()
    first = [r[0] for r in rows.orderBy(F.xxhash64("v"), "b").limit(sample).select("v").collect()]
    if not first:
        return rows.select(F.col("k").alias(key), F.col("x").alias(vector))
    clusters = min(clusters or max(1, min(round(n / 30), 100)), len(first))
    x = np.array(first)
    nb, d = len(names), x.shape[1]
    if clusters * nb * d > MOST_NUMBERS:
        raise ValueError(f"{clusters} clusters, {nb} batches and {d} dimensions are over {MOST_NUMBERS} coefficients")
    centres = x[np.linspace(0, len(x) - 1, clusters).astype(int)].copy()
    share = np.zeros(nb)
    for r in rows.groupBy("b").count().collect():
        share[r["b"]] = r["count"] / n
    penalty = np.ones((clusters, nb))
    best, kept = np.inf, []
    for round_ in range(rounds):
        if round_:
            rows = dealt(corrected, round_)  # noqa: F821
        penalties = np.repeat(penalty[None], blocks, axis=0)
        stats = _sums(rows, centres, penalties, sigma, nb, range(blocks))
        turn_values: list[float] = []
        state = None
        for _ in range(turns):
            middle = stats.sum(0)[:, nb : nb + d]
            tried, tried_stats, tried_centres = penalties.copy(), stats.copy(), _unit(middle)
            for block in range(blocks):
                rest = tried_stats.sum(0) - tried_stats[block]
                mass = rest[:, :nb]
                tried[block] = ((mass.sum(1, keepdims=True) * share + 1) / (mass + 1)) ** theta
                tried_stats[block] = _sums(rows, tried_centres, tried, sigma, nb, [block])[block]
            value = _objective(tried_stats.sum(0), share, sigma, theta, nb)
            if turn_values and value > turn_values[-1]:
                break
            fell = not turn_values or turn_values[-1] - value > tolerance * abs(turn_values[-1])
            turn_values.append(value)
            state = penalties, stats, centres = tried, tried_stats, tried_centres
            if not fell:
                break
        penalties, stats, centres = state
        if turn_values[-1] > best:
            work.drop(rows)
            break
        if kept:
            work.drop(kept.pop())
        if history is not None:
            history.append(turn_values)
        offsets = _regressions(rows, centres, penalties, sigma, nb, ridge)
        corrected = _applied(rows, centres, penalties, sigma, offsets, schema)
        kept.append(rows)
        settled = best - turn_values[-1] <= tolerance * abs(best) if np.isfinite(best) else False
        result, best = corrected, turn_values[-1]
        mass = stats.sum(0)[:, :nb]
        penalty = ((mass.sum(1, keepdims=True) * share + 1) / (mass + 1)) ** theta
        if settled:
            break
    return result.select(F.col("k").alias(key), F.col("x").alias(vector))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-8)


def _arrays(part: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) for c in columns]


def _soft(x: np.ndarray, b: np.ndarray, centres: np.ndarray, penalty: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of rows in clusters, and distances."""
    distance = 2 * (1 - x @ centres.T)
    r = np.exp(-(distance - distance.min(1, keepdims=True)) / sigma) * penalty[:, b].T
    return r / r.sum(1, keepdims=True), distance


def _objective(total: np.ndarray, share: np.ndarray, sigma: float, theta: float, nb: int) -> float:
    mass = total[:, :nb]
    expected = mass.sum(1, keepdims=True) * share
    return float(total[:, -2].sum() + sigma * total[:, -1].sum() + sigma * theta * (mass * np.log((mass + 1) / (expected + 1))).sum())


def _added(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in group:
        for blob in part.column("m"):
            m = np.frombuffer(blob.as_buffer())
            total = m.copy() if total is None else total + m
    ids = [pa.array([k.as_py()], pa.int32()) for k in key]
    yield pa.RecordBatch.from_arrays([*ids, pa.array([total.tobytes()], pa.binary())], ["block", "c", "m"])


def _sums(rows: DataFrame, centres: np.ndarray, penalties: np.ndarray, sigma: float, nb: int, blocks) -> np.ndarray:
    """By block and cluster: mass of each batch, sum of vectors, distances and entropy; blocks not asked for are 0."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, penalties, sigma, nb))
    schema = "block int, c int, m binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, pens, width, known = shared.value
        totals: dict[int, np.ndarray] = {}
        for part in batches:
            if not len(part):
                continue
            (x,), b, block = _arrays(part, "x"), part.column("b").to_numpy(), part.column("block").to_numpy()
            for here in np.unique(block).tolist():
                mine = block == here
                r, distance = _soft(x[mine], b[mine], c, pens[here], width)
                mass = np.stack([r[b[mine] == j].sum(0) for j in range(known)], axis=1) if known < 64 else r.T @ np.eye(known)[b[mine]]
                found = np.hstack([mass, r.T @ x[mine], (r * distance).sum(0)[:, None], (r * np.log(np.maximum(r, 1e-300))).sum(0)[:, None]])
                totals[here] = totals[here] + found if here in totals else found
        for here, total in totals.items():
            k = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([here] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["block", "c", "m"])

    asked = rows.where(F.col("block").isin(list(blocks))).select("b", "x", "block")
    out = np.zeros((len(penalties), len(centres), nb + centres.shape[1] + 2))
    for r in map_arrow(asked, run, schema).groupBy("block", "c").applyInArrow(_added, schema).collect():
        out[r["block"], r["c"]] = np.frombuffer(r["m"])
    return out


def _regressions(rows: DataFrame, centres: np.ndarray, penalties: np.ndarray, sigma: float, nb: int, ridge: float) -> np.ndarray:
    """(clusters, batches, dimensions): what a batch adds to a cluster's original vectors, each cluster solved where its sums meet."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, penalties, sigma))
    k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, pens, width = shared.value
        total = np.zeros((k, nb, d + 1))
        for part in batches:
            if not len(part):
                continue
            (x, v), b, block = _arrays(part, "x", "v"), part.column("b").to_numpy(), part.column("block").to_numpy()
            v = np.hstack([v, np.ones((len(v), 1))])
            for here in np.unique(block).tolist():
                for j in np.unique(b[block == here]).tolist():
                    mine = (block == here) & (b == j)
                    total[:, j] += _soft(x[mine], b[mine], c, pens[here], width)[0].T @ v[mine]
        yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["block", "c", "m"])

    def solve(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _added(key, group):
            total = np.frombuffer(part.column("m")[0].as_buffer()).reshape(nb, d + 1)
            sums, mass = total[:, :d], total[:, d:]
            damped = mass / (mass + ridge)
            rest = (mass * (1 - damped)).sum()
            intercept = (sums * (1 - damped)).sum(0) / rest if rest > 1e-12 else np.zeros(d)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([((sums - mass * intercept) / (mass + ridge)).tobytes()], pa.binary())], ["block", "c", "m"])

    schema = "block int, c int, m binary"
    out = np.zeros((k, nb, d))
    for r in map_arrow(rows.select("b", "x", "v", "block"), run, schema).groupBy("block", "c").applyInArrow(solve, schema).collect():
        out[r["c"]] = np.frombuffer(r["m"]).reshape(nb, d)
    return out


def _applied(rows: DataFrame, centres: np.ndarray, penalties: np.ndarray, sigma: float, offsets: np.ndarray, schema: str) -> DataFrame:
    """Rows with x, the original vectors less their clusters' offsets of their batch."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, penalties, sigma, offsets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, pens, width, off = shared.value
        for part in batches:
            if not len(part):
                continue
            (x, v), b, block = _arrays(part, "x", "v"), part.column("b").to_numpy(), part.column("block").to_numpy()
            out = v.copy()
            for here in np.unique(block).tolist():
                for j in np.unique(b[block == here]).tolist():
                    mine = (block == here) & (b == j)
                    out[mine] -= _soft(x[mine], b[mine], c, pens[here], width)[0] @ off[:, j]
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("b"), part.column("v"), pa.array(list(_unit(out)), pa.list_(pa.float64()))], ["k", "b", "v", "x"])

    return map_arrow(rows.select("k", "b", "v", "x", "block"), run, schema)
