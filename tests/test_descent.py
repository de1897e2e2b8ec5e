"""Neighbour descent against all pairs."""

import numpy as np
import pytest

from lumenframe.operators import descent, vectors


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], f"id long, v array<{kind}>, since int").repartition(5)


def exact(rows, k, metric):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    if metric == "cosine":
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        d = 1 - x @ x.T
    else:
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    return {int(i): [(int(ids[j]), d[a, j]) for j in np.lexsort((ids, np.round(d[a], 9)))[:k]] for a, i in enumerate(ids)}


@pytest.mark.parametrize(("metric", "kind"), [("cosine", "float"), ("euclidean", "double")])
def test_lists_are_nearly_the_exact_ones(spark, metric, kind):
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((40, 12))[rng.integers(0, 40, 1500)] + 0.7 * rng.standard_normal((1500, 12))).astype(np.float32)
    rows = [(3 * i - 500, r.tolist()) for i, r in enumerate(v)]
    want = exact(rows, 8, metric)
    out = descent.approximate_neighbours(table(spark, rows, kind), "id", "v", 8, metric, search=20, sample=10, trees=2).collect()
    assert len(out) == 8 * 1500 and len({(r.src, r.dst) for r in out}) == len(out)
    hit = sum(r.dst in {d for d, _ in want[r.src]} for r in out)
    assert hit / len(out) > 0.95
    true = {i: dict(row) for i, row in exact(rows, 1499, metric).items()}
    assert all(r.src != r.dst and abs(r.distance - true[r.src][r.dst]) < 1e-6 for r in out)
    assert all(sorted(x.rank for x in out if x.src == i) == list(range(1, 9)) for i in (-500, 400))


def test_the_same_lists_in_any_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, r.tolist()) for i, r in enumerate(rng.standard_normal((600, 6)))]
    run = lambda parts: sorted(tuple(r)[:3] for r in descent.approximate_neighbours(table(spark, rows, "double").repartition(parts), "id", "v", 4, rounds=3).collect())
    assert run(1) == run(6)


def test_copies_of_one_vector_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 5))
    v[:400] = v[0]  # copies that share every block
    v[400] = 0
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 5), (None, [1.0] * 5), rows[7], rows[7]]
    out = descent.approximate_neighbours(table(spark, rows + odd, "double"), "id", "v", 6).collect()
    assert {r.src for r in out} == set(range(900)) and len(out) == 900 * 6
    assert all(abs(r.distance) < 1e-9 and r.dst < 400 for r in out if r.src < 400)
    assert all(r.distance == 1 for r in out if r.src == 400)


def test_fewer_rows_than_neighbours(spark):
    out = descent.approximate_neighbours(table(spark, [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])]), "id", "v", 9).collect()
    assert sorted((r.src, r.dst, r.rank) for r in out) == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 2, 1), (3, 1, 2)] or len(out) == 6
    assert descent.approximate_neighbours(table(spark, [(1, [1.0])]), "id", "v", 3).count() == 0
    assert descent.approximate_neighbours(table(spark, []).where("false"), "id", "v", 3).count() == 0
    with pytest.raises(ValueError):
        descent.approximate_neighbours(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]), "id", "v", 3)


def test_recall_of_lists(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    assert descent.recall(a.limit(1), a).first()[0] == 0.5


def test_it_agrees_with_the_exact_join_on_its_rule_for_ties(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    df = table(spark, rows, "double")
    near = lambda out: {(r.src, r.rank): r.dst for r in out.collect()}
    assert near(descent.approximate_neighbours(df, "id", "v", 3)) == near(vectors.exact_neighbours(df, "id", "v", 3))


def test_blocks_and_one_round_find_most_neighbours_of_vectors_without_structure(spark):
    rows = [(i, r.tolist()) for i, r in enumerate(np.random.default_rng(4).standard_normal((4000, 48)))]
    out = descent.approximate_neighbours(table(spark, rows, "double"), "id", "v", 10, trees=2, rounds=1).collect()
    want = exact(rows, 10, "cosine")
    assert sum(r.dst in {d for d, _ in want[r.src]} for r in out) / len(out) > 0.75


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_by_pivots_of_two_levels(spark, monkeypatch, metric):
    monkeypatch.setattr(descent, "LEAF", 16)
    monkeypatch.setattr(descent, "PIVOT_NUMBERS", 60)
    rng = np.random.default_rng(6)
    rows = [(i, r.tolist()) for i, r in enumerate(5 + rng.standard_normal((1500, 6)))]
    out = descent.approximate_neighbours(table(spark, rows, "double"), "id", "v", 5, metric, search=15, sample=8, trees=3, rounds=2).collect()
    want = exact(rows, 5, metric)
    assert len(out) == 7500 and sum(r.dst in {d for d, _ in want[r.src]} for r in out) / 7500 > 0.9


def test_lists_are_merged_by_one_shuffle(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5, 1, False), (1, 2, None, None, True), (1, 3, 0.25, 2, False), (1, 4, 0.75, 0, True)], "src long, dst long, distance double, since int, used boolean")
    out = descent._nearest(pairs, 2, 3)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 0.5, 1, True), (1, 3, 0.25, 2, False)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange") == 1


def test_vectors_are_sent_only_to_rows_that_have_something_new(spark):
    lists = spark.createDataFrame([(1, 2, 0.1, 0, True), (2, 1, 0.1, 0, True), (3, 4, 0.1, 1, False)], "src long, dst long, distance double, since int, used boolean")
    out = sorted(tuple(r) for r in descent._sampled(lists, 5, 1, 2).collect())
    assert out == [(3, 4, True, True), (4, 3, True, False)]


def test_rows_that_batches_cut_are_brought_together_whole(spark):
    x = np.random.default_rng(7).standard_normal((9, 3))
    members = [(at, i, True, float("inf"), x[i].tobytes()) for at in range(4) for i in range(9)]
    brought = spark.createDataFrame(members, "at long, of long, fresh boolean, worst double, v binary").coalesce(1).sortWithinPartitions("at", "of")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        out = [(r.src, r.dst) for r in descent._local_joins(brought, np.dtype(np.float64), 3, "euclidean").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(out) == sorted([(i, j) for i in range(9) for j in range(9) if i != j] * 4)
