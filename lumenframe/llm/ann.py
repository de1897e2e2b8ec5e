"""Approximate nearest neighbours with a permutation index.

Every vector is represented by its nearest pivots in order. The index is cut into shards of a few thousand
vectors, each posted in inverted files: for every pivot the vectors that have it in their prefix, and at which rank. A query
is posted the same way; walking the inverted files of its pivots gives its footrule distance to every vector of
the shard, the nearest of them are reranked by exact cosine, and the shards' best are merged. How many are reranked grows
slower than the table; the inverted files are walked for every query, so that part of the work is queries times vectors.

With prefixes of m pivots, a pivot that is missing counts as rank m; the footrule distance is then a constant less
2 * (m - max(r, s)) for each pivot that both have, at ranks r and s.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import Workspace, integer_id, map_arrow

PIVOTS = 256
PREFIX = 48
#: Candidates that are reranked for a query out of n vectors: RERANKED * n ** POWER, and LEAST at least, spread over the shards.
RERANKED = 10.0
POWER = 0.6
LEAST = 1024
SHARD = 4096
BLOCK = 1024
_PACKED = "g long, ids binary, vectors binary, pivots binary"


def candidates(n: int) -> int:
    """How many of n vectors are reranked: sublinear, and all of a few."""
    return max(LEAST, int(np.ceil(RERANKED * n**POWER)))


def usable(vector: str) -> F.Column:
    """True for vectors that take part: finite components, not all of them zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors over a power of two near their largest component: exact, and their squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, summed component after component."""
    total = np.zeros(len(vectors))
    for column in vectors.T:
        total += column * column
    return np.sqrt(total)


def _order(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest ``prefix`` pivots of each vector, nearest first, of equals the first."""
    unit = _scaled(vectors)
    unit /= _norms(unit)[:, None]
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix].astype("<u2")


def choose_pivots(df: DataFrame, count: int, n: int) -> np.ndarray:
    """Unit vectors of distinct directions, at most ``count`` of them, from the 4 * ``count`` of ``n`` rows with the smallest hashed ids: a bounded
    sample, in which copies of one vector are one pivot. Only rows below a hash that about twice as many have are sorted, since every task
    sends the driver as many rows as are taken."""
    wanted, h = min(n, 4 * count), F.xxhash64("id")
    few = df.where(h <= min(2**63 - 1, -(2**63) + 2**64 * 2 * wanted // max(1, n)))
    first = lambda t: t.orderBy(h, "id").limit(wanted).select("vector").collect()
    rows = first(few)
    if len(rows) < wanted:  # ids that repeat, so their hashes are spread unevenly
        rows = first(df)
    out = _scaled(np.array([r["vector"] for r in rows], np.float64))
    out /= _norms(out)[:, None]
    first = np.unique(np.round(out, 9), axis=0, return_index=True)[1]
    return out[np.sort(first)[:count]]


def _pack(rows: DataFrame, pivots: np.ndarray, prefix: int, size: int) -> DataFrame:
    """Rows (id, vector) in shards of at most ``size``, each a row of _PACKED; ids ascend within it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column("id").to_numpy(), kind="stable")
            for low in range(0, len(order), size):
                part = batch.take(pa.array(order[low : low + size]))
                ids = part.column("id").to_numpy()
                vectors = part.column("vector").flatten().to_numpy().reshape(len(ids), width)
                blobs = [ids.astype("<i8"), vectors.astype("<f8"), _order(vectors, shared.value, prefix)]
                first = int(np.bitwise_xor.reduce(ids * 0x9E3779B1 % (1 << 40)))
                yield pa.RecordBatch.from_arrays([pa.array([first]), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]], ["g", "ids", "vectors", "pivots"])

    return map_arrow(rows, run, _PACKED)


def _footrule_gain(queries: np.ndarray, vectors: np.ndarray, pivots: int) -> np.ndarray:
    """How much each shared pivot takes off the footrule distance, summed, by query and vector; via inverted files."""
    m = queries.shape[1]
    gain = np.zeros((len(queries), len(vectors)), np.int32)

    def posted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = rows.reshape(-1)
        order = np.argsort(flat, kind="stable")
        return order // m, order % m, np.searchsorted(flat[order], np.arange(pivots + 1))

    q_row, q_rank, q_at = posted(queries)
    v_row, v_rank, v_at = posted(vectors)
    for p in range(pivots):
        a, b = slice(q_at[p], q_at[p + 1]), slice(v_at[p], v_at[p + 1])
        if a.stop > a.start and b.stop > b.start:
            gain[q_row[a][:, None], v_row[b][None, :]] += 2 * (m - np.maximum(q_rank[a][:, None], v_rank[b][None, :])).astype(np.int32)
    return gain


def _search(pivots: int, width: int, k: int, share: float):
    def one(row: dict) -> pa.RecordBatch:
        ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
        vectors = _scaled(np.frombuffer(row["vectors"], "<f8").reshape(len(ids), width))
        queries = _scaled(np.frombuffer(row["q_vectors"], "<f8").reshape(len(q_ids), width))
        prefix = len(row["pivots"]) // 2 // len(ids)
        gain = _footrule_gain(np.frombuffer(row["q_pivots"], "<u2").reshape(-1, prefix), np.frombuffer(row["pivots"], "<u2").reshape(-1, prefix), pivots)
        norms, q_norms = _norms(vectors), _norms(queries)
        take = int(np.ceil(1.2 * share * len(ids))) + 8  # the query itself may be among them, and shards differ
        found = []
        for i, q in enumerate(q_ids):
            at = np.arange(len(ids))
            if take < len(ids):  # all that are as near as the last one, so copies don't push each other out
                at = np.flatnonzero(gain[i] >= np.partition(gain[i], len(ids) - take)[len(ids) - take])
            at = at[ids[at] != q]
            near, total = vectors[at].T, np.zeros(len(at))
            for column, x in zip(near, queries[i].tolist(), strict=True):
                total += column * x
            score = total / (norms[at] * q_norms[i])
            best = np.argsort(-score, kind="stable")[:k]  # ids ascend, so of equals the smaller one is first
            found.append((np.full(len(best), q), ids[at[best]], score[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield one({c: batch.column(c)[i].as_buffer() for c in batch.schema.names if c != "g"})

    return run


def nearest(
    df: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    reranked: int | None = None,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` rows of ``df`` nearest by cosine to each row of ``queries`` that the index finds, never the query itself.

    query_id, rank (from 1), vec_id, score: nearest first, ties to the smaller id. ``reranked``: how many vectors are compared
    exactly with a query, ``candidates(n)`` by default. Vectors that are null or zero or hold null or non-finite components take no part
    on either side, and neither do rows without an id. A cosine needs vectors of one length: each length has an index of its own, so a
    vector of another length changes nothing but itself. With fewer candidates than ``k`` a query has as many rows. Rows that repeat an id
    are candidates each, none of them for a query of that id; of the queries that repeat an id the smallest vector is asked. Ids are
    integers. Empty tables give no rows; other columns aren't read.
    """
    spark = df.sparkSession
    rows, asked = (t.select(integer_id(t, id_col).alias("id"), t[vector_col].cast("array<double>").alias("vector")).where(usable("vector") & F.col("id").isNotNull()) for t in (df, queries))
    asked = asked.groupBy("id", F.size("vector").alias("width")).agg(F.min("vector").alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).join(asked.groupBy("width").agg(F.count("*").alias("q")), "width").orderBy("width").collect()
    found = [_of_width(rows, asked, r["width"], r["n"], r["q"], k, pivots, prefix, reranked, shard, block) for r in sizes]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = functools.reduce(DataFrame.unionAll, found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_width(rows: DataFrame, asked: DataFrame, width: int, n: int, n_asked: int, k: int, pivots: int, prefix: int, reranked: int | None, shard: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each shard of the vectors of one length."""
    spark = rows.sparkSession
    rows, asked = (t.where(F.size("vector") == width).select("id", "vector") for t in (rows, asked))
    chosen = choose_pivots(rows, pivots, n)
    prefix = min(prefix, len(chosen))
    work = Workspace(spark, "ann")
    index = work.save(_pack(rows, chosen, prefix, shard))
    groups = min(index.count(), max(1, 4 * spark.sparkContext.defaultParallelism))
    packed = work.save(_pack(asked.repartition(-(-n_asked // block), F.xxhash64("id")), chosen, prefix, block))
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("pivots").alias("q_pivots"))
    # shuffled in any case: the size of the files says nothing of ``sent``, which is ``groups`` times that, and a broadcast would take all of it through the driver
    pairs = index.withColumn("g", F.pmod(F.xxhash64("g"), F.lit(groups)).cast("int")).join(sent.hint("merge"), "g")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    return map_arrow(pairs, _search(len(chosen), width, k, (reranked or candidates(n)) / n), schema)
