"""Two-dimensional layouts of weighted graphs by stochastic gradient descent: edges pull, random nodes push.

``graph_layout`` works on chunks of edges. A chunk holds all edges of some nodes, moves these nodes in a few steps against the others as it knows them, and
the new positions are exchanged by key between rounds. Nodes are dealt to chunks by hash, so the nodes of a chunk are a random sample and give its
random nodes. A node with very many edges has them in several chunks, and its position is the mean of theirs by edges. ``positions`` is the same
descent over one graph in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Workspace

#: Edges of a chunk, about; a node with over HUB edges is dealt to several.
CHUNK, HUB = 1 << 14, 1 << 11
#: A node moves by the sum of its edges' moves in a part of a step, and of more edges than this by so many times their mean.
MANY = 2


def curve(spread: float = 1.0, least: float = 0.1) -> tuple[float, float]:
    """a and b such that 1 / (1 + a d ** 2b) is close to 1 up to ``least`` and falls off with ``spread`` beyond: least squares on a grid."""
    d = np.linspace(0.01, 3 * spread, 300)
    goal = np.where(d < least, 1.0, np.exp(-(d - least) / spread))
    best = (np.inf, 1.0, 1.0)
    low, high = np.array([0.1, 0.4]), np.array([6.0, 2.0])
    for _ in range(6):
        for a in np.linspace(low[0], high[0], 25):
            for b in np.linspace(low[1], high[1], 25):
                best = min(best, (float((((1 / (1 + a * d ** (2 * b))) - goal) ** 2).sum()), float(a), float(b)))
        width = (high - low) / 8
        low, high = np.maximum(np.array(best[1:]) - width, 1e-3), np.array(best[1:]) + width
    return best[1], best[2]


def positions(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, epochs: int = 200, negatives: int = 5, rate: float = 1.0, seed: int = 42, least: float = 0.1) -> np.ndarray:
    """Coordinates of n nodes; edges are given in both directions."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-10, 10, (n, 2))
    if not len(w):
        return x
    rates = rate * (1 - np.arange(epochs) / epochs)
    return _descended(x, np.arange(n), src, dst, w / w.max(), rates, negatives, rng, *curve(least=least))


def _pull(gap: np.ndarray, a: float, b: float) -> np.ndarray:
    d2 = (gap * gap).sum(1)
    return np.clip((-2 * a * b * np.power(np.maximum(d2, 1e-12), b - 1) / (1 + a * np.power(d2, b)))[:, None] * gap, -4, 4)


def _push(gap: np.ndarray, a: float, b: float) -> np.ndarray:
    d2 = (gap * gap).sum(1)
    return np.clip((2 * b / ((0.001 + d2) * (1 + a * np.power(d2, b))))[:, None] * gap, -4, 4)


def _summed(at: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=moves[:, c], minlength=n) for c in (0, 1)], axis=1)


def _descended(x: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, chance: np.ndarray, rates: np.ndarray, negatives: int, rng: np.random.Generator, a: float, b: float) -> np.ndarray:
    """Positions after a step for each of ``rates``. Edges lead from nodes i, which are ``own`` and move, to nodes j. In a step an edge takes part by
    chance; as both of its directions pull both of its ends, it pulls i twice, and i is pushed ``negatives`` times. A step is made in as many parts as
    leave a node about one edge in each, so that a node doesn't leap by the sum of its edges."""
    for rate in rates:
        on = np.flatnonzero(rng.random(len(chance)) < chance)
        both = rng.permutation(2 * len(on))
        for part in np.array_split(both, max(1, -(-len(both) // len(own)))):
            edge = on[part % max(1, len(on))]
            at = i[edge]
            move = _summed(at, _pull(x[at] - x[j[edge]], a, b), len(x))
            at = at[part < len(on)]
            for _ in range(negatives):
                k = own[rng.integers(0, len(own), len(at))]
                move += _summed(at, np.where((k != at)[:, None], _push(x[at] - x[k], a, b), 0), len(x))
            x = x + rate * move / np.maximum(1, np.bincount(i[edge], minlength=len(x)) / MANY)[:, None]
    return x


def graph_layout(edges: DataFrame, nodes: DataFrame, key: str, rounds: int = 20, steps: int = 10, negatives: int = 5, rate: float = 1.0, seed: int = 42, least: float = 0.1, start: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(key, umap1, umap2), a row for each node: ``rounds`` times ``steps`` steps at a falling rate. start: (key, x, y) to begin from, for instance two principal
    components scaled to about 10; others begin at places hashed from their key and the seed.

    A round shuffles one position for each node that a chunk's edges touch, and writes the new ones; the edges stay where they are. Nothing is on the
    driver. Edges may be given in one direction or both (the larger weight counts); loops, and edges with a null end or without a positive weight, are left out, as are
    ends that aren't nodes. Null nodes are left out and repeated ones are one; a node without edges stays where it began; an empty table gives no rows."""
    work = Workspace(edges.sparkSession, "layout")
    ids = nodes.select(F.col(key).cast("long").alias("node")).dropna().distinct()
    at = lambda c: F.pmod(F.xxhash64("node", F.lit(seed), F.lit(c)), F.lit(1_000_003)) / 1_000_003 * 20 - 10
    begun = ids.select("node", at(1).alias("x"), at(2).alias("y"))
    if start is not None:
        given = start.select(F.col(key).cast("long").alias("node"), F.col("x").cast("double").alias("gx"), F.col("y").cast("double").alias("gy")).dropDuplicates(["node"])
        begun = begun.join(given, "node", "left").select("node", F.coalesce("gx", "x").alias("x"), F.coalesce("gy", "y").alias("y"))
    begun = work.save(begun)
    one = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")).where("src <> dst and w > 0")
    both = one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    both = both.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    graph = work.save(both)
    n, most = graph.agg(F.count("*"), F.max("w")).first()
    chunks = max(1, -(-n // chunk))
    parts = graph.groupBy("src").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1")
    dealt = graph.join(parts, "src", "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))))
    dealt = work.save(dealt.select(F.pmod(F.xxhash64("src", "part", F.lit(seed)), F.lit(chunks)).alias("chunk"), "src", "dst", (F.col("w") / F.lit(most or 1.0)).alias("w")))
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks // 64)
    laid = dealt.repartition(tasks, "chunk").sortWithinPartitions("chunk").persist()
    ends = dealt.select("chunk", F.col("src").alias("node"), F.lit(True).alias("own")).unionAll(dealt.select("chunk", F.col("dst").alias("node"), F.lit(False).alias("own")))
    touched = work.save(ends.groupBy("chunk", "node").agg(F.max("own").alias("own"))).repartition(tasks, "node").persist()
    now, curve_a_b = begun, curve(least=least)
    try:
        for turn in range(rounds if n else 0):
            new = work.save(_round(laid, touched.join(now, "node"), turn, rounds, steps, negatives, rate, seed, curve_a_b))
            if turn:
                work.drop(now)
            now = new
    finally:
        laid.unpersist()
        touched.unpersist()
    out = begun.select("node", F.col("x").alias("bx"), F.col("y").alias("by")).join(now, "node", "left")
    return out.select(F.col("node").alias(key), F.coalesce("x", "bx").alias("umap1"), F.coalesce("y", "by").alias("umap2"))


def _round(laid: DataFrame, placed: DataFrame, turn: int, rounds: int, steps: int, negatives: int, rate: float, seed: int, curve_a_b: tuple[float, float]) -> DataFrame:
    """(node, x, y) of the nodes with edges, after a round of steps in every chunk."""

    def run(key: tuple[pa.Scalar, ...], mine: pa.Table, them: pa.Table) -> pa.Table:
        them = them.sort_by("node")
        node, own = (them.column(c).to_numpy() for c in ("node", "own"))
        src, dst, w = (mine.column(c).to_numpy() for c in ("src", "dst", "w"))
        order = np.lexsort((dst, src))
        i, j, w = np.searchsorted(node, src[order]), np.searchsorted(node, dst[order]), w[order]
        x = np.stack([them.column("x").to_numpy(), them.column("y").to_numpy()], axis=1)
        movers = np.flatnonzero(own)
        rates = rate * (1 - (turn * steps + np.arange(steps)) / (rounds * steps))
        x = _descended(x, movers, i, j, w, rates, negatives, np.random.default_rng([seed, turn, key[0].as_py()]), *curve_a_b)
        return pa.table({"node": node[movers], "x": x[movers, 0], "y": x[movers, 1], "m": np.bincount(i, minlength=len(node))[movers].astype(float)})

    moved = laid.groupBy("chunk").cogroup(placed.groupBy("chunk")).applyInArrow(run, "node long, x double, y double, m double")
    mean = lambda c: (F.sum(F.col(c) * F.col("m")) / F.sum("m")).alias(c)
    return moved.groupBy("node").agg(mean("x"), mean("y"))
