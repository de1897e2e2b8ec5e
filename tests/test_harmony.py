"""Batch correction: falling objectives, mixed batches, kept groups, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import harmony


def rows(n=240, d=6, seed=0):
    """Three groups in every batch; a batch shifts its rows."""
    rng = np.random.default_rng(seed)
    groups, shifts = rng.normal(size=(3, d)) * 3, rng.normal(size=(3, d))
    return [(i, "pqr"[i % 3], i // 3 % 3, (groups[i // 3 % 3] + shifts[i % 3] + rng.normal(size=d) * 0.2).tolist()) for i in range(n)]


def excess(x, batch, k=10):
    near = np.argsort(-(x @ x.T), axis=1)[:, 1 : k + 1]
    return (batch[near] == batch[:, None]).mean() - np.mean(batch[:, None] == batch[None])


def test_objective_falls_and_batches_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, "k long, b string, g int, v array<double>").repartition(5)
    history = []
    out = {r.k: np.array(r.v) for r in harmony.harmonised(df, "k", "v", "b", clusters=6, blocks=3, history=history).collect()}
    assert len(out) == len(data)
    after = np.stack([out[i] for i in range(len(data))])
    assert after.shape == (240, 6) and np.allclose(np.linalg.norm(after, axis=1), 1)
    for turn in history:
        assert all(a >= b for a, b in zip(turn, turn[1:], strict=False))
    ends = [t[-1] for t in history]
    assert len(ends) >= 2 and all(a >= b for a, b in zip(ends, ends[1:], strict=False))
    before = harmony._unit(np.array([r[3] for r in data]))
    batch, group = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    assert excess(before, batch) > 0.4 and excess(after, batch) < 0.5 * excess(before, batch)
    same = group[np.argsort(-(after @ after.T), axis=1)[:, 1:11]] == group[:, None]
    assert same.mean() > 0.95  # groups stay apart


def test_one_block_of_one_cluster_is_a_ridge_regression(spark):
    """With one cluster every share is 1, so the correction is a regression on the batch that can be written down."""
    data = rows(30)
    df = spark.createDataFrame(data, "k long, b string, g int, v array<double>")
    out = {r.k: np.array(r.v) for r in harmony.harmonised(df, "k", "v", "b", clusters=1, rounds=1, blocks=1, ridge=2.0).collect()}
    v, batch = harmony._unit(np.array([r[3] for r in data])), np.array(["pqr".index(r[1]) for r in data])
    design = np.hstack([np.ones((30, 1)), np.eye(3)[batch]])
    w = np.linalg.solve(design.T @ design + np.diag([0, 2.0, 2.0, 2.0]), design.T @ v)
    want = harmony._unit(v - w[1:][batch])
    assert np.allclose(np.stack([out[i] for i in range(30)]), want)


def test_odd_rows(spark):
    data = [(0, "a", [1.0, 0.0]), (1, None, [0.0, 1.0]), (2, "a", None), (3, "b", [None, 2.0]), (4, "b", [float("nan"), 1.0]), (0, "a", [1.0, 0.0]), (5, "b", [0.0, 0.0])]
    df = spark.createDataFrame(data, "k long, block string, v array<double>").withColumnRenamed("block", "b").withColumn("x", F.lit("extra"))
    out = harmony.harmonised(df, "k", "v", "b", blocks=2, rounds=2)
    assert out.columns == ["k", "v"]
    got = out.collect()
    assert sorted(r.k for r in got) == [0, 0, 1, 3, 4, 5] and all(np.isfinite(r.v).all() for r in got)
    assert harmony.harmonised(df.where("false"), "k", "v", "b").count() == 0
    assert harmony.harmonised(df.where("v is null or k = 1"), "k", "v", "b").count() == 1
    with pytest.raises(ValueError, match="batches"):
        harmony.MOST_BATCHES, before = 1, harmony.MOST_BATCHES
        try:
            harmony.harmonised(df, "k", "v", "b")
        finally:
            harmony.MOST_BATCHES = before
