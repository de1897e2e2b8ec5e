"""The layout by chunks against the one in memory."""

import numpy as np

from lumenframe.operators import layout


def graph(seed=0, n=500, k=10):
    rng = np.random.default_rng(seed)
    x = 2 * rng.standard_normal((12, 6))[rng.integers(0, 12, n)] + 0.6 * rng.standard_normal((n, 6))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1)[:, :k]


def kept(y, near):
    d = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1)[:, : near.shape[1]]
    return np.mean([len(set(a) & set(b)) / near.shape[1] for a, b in zip(best, near, strict=True)])


def test_neighbourhoods_are_kept_as_in_memory(spark):
    near = graph()
    pairs = sorted({(i, int(j)) for i, row in enumerate(near) for j in row})
    edges = spark.createDataFrame([(i, j, 1.0, 0) for i, j in pairs], "src long, dst long, w double, chunk int").repartition(4)
    out = layout.graph_layout(edges, spark.range(500), "id", rounds=6, steps=20, chunk=1 << 11).orderBy("id").collect()
    assert [r.id for r in out] == list(range(500))
    both = np.array(sorted({*pairs, *((j, i) for i, j in pairs)}))
    memory = layout.positions(500, both[:, 0], both[:, 1], np.ones(len(both)), epochs=120)
    assert kept(np.array([(r.umap1, r.umap2) for r in out]), near) > 0.6 * kept(memory, near) > 10 * 10 / 500 * 0.6


def test_a_start_odd_rows_and_reruns(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 3.0), (3, 3, 1.0), (None, 1, 1.0), (1, None, 1.0), (1, 3, None), (4, 1, 0.0), (4, 1, -1.0), (1, 99, 2.0)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(i, 0.0) for i in (1, 2, 3, 4, 4, None)], "id long, x double")
    start = spark.createDataFrame([(3, 5.0, 6.0), (3, 5.0, 6.0), (1, -1.0, None)], "id long, x double, y double")
    lay = lambda: sorted((r.id, r.umap1, r.umap2) for r in layout.graph_layout(edges, nodes, "id", rounds=2, steps=5, start=start).collect())
    out = lay()
    assert [r[0] for r in out] == [1, 2, 3, 4] and out[2][1:] == (5.0, 6.0) and all(np.isfinite(r[1:]).all() for r in out) and lay() == out
    assert layout.graph_layout(edges.where("false"), nodes, "id").count() == 4
    assert layout.graph_layout(edges, nodes.where("false"), "id").count() == 0


def test_a_hub_lies_in_several_chunks(spark):
    n = 3 * layout.HUB
    edges = spark.range(1, n + 1).selectExpr("0L as src", "id as dst", "1.0d as w")
    out = {r.id: (r.umap1, r.umap2) for r in layout.graph_layout(edges, spark.range(n + 1), "id", rounds=3, steps=4).collect()}
    assert len(out) == n + 1
    leaves = np.array([out[i] for i in range(1, n + 1)])
    assert np.isfinite(leaves).all() and np.hypot(*(leaves.mean(0) - out[0])) < leaves.std()
