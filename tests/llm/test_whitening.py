"""Whitening against exact fractions and plain eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import queries, whitening


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<float>, x int, key string").repartition(3)


def exact_covariance(x):
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    top = [[n * v - t for v, t in zip(r, total, strict=True)] for r in x]
    d = len(total)
    return [[Fraction(sum(r[i] * r[j] for r in top), n**3) for j in range(d)] for i in range(d)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 9)) * np.geomspace(30, 0.3, 9) + 100 * rng.standard_normal(9)
    return [r.astype(np.float32).tolist() for r in v]


def test_error_free_sums():
    rng = np.random.default_rng(0)
    for scale in (1.0, 1e-9):
        x = rng.integers(10**6 - 4000, 10**6 + 4000, (600, 5))
        x[:, 0] = 10**6 + (rng.random(600) < 0.01)  # hardly varies
        n, total = len(x), x.sum(0)
        d, rest = whitening.centred(x, n, total)
        for i, j in ((0, 0), (599, 4), (17, 2)):
            want = Fraction(int(n * x[i, j] - total[j]), n)
            assert abs(Fraction(d[i, j]) + Fraction(rest[i, j]) - want) <= abs(want) * Fraction(1, 2**100)
        high, low = whitening.outer(np.zeros((5, 5)), np.zeros((5, 5)), d * scale, rest * scale)
        want = [[sum((Fraction(a * scale) + Fraction(b * scale)) * (Fraction(c * scale) + Fraction(e * scale)) for a, b, c, e in zip(d[:, i], rest[:, i], d[:, j], rest[:, j], strict=True)) for j in range(5)] for i in range(5)]
        size = max(map(max, want))
        assert all(abs(Fraction(high[i, j]) + Fraction(low[i, j]) - want[i][j]) <= size * Fraction(1, 2**95) for i in range(5) for j in range(5))


def test_covariance_is_the_exact_one_rounded(spark, vectors):
    rows = whitening.quantised(table(spark, list(enumerate(vectors))))
    x = [r.x for r in rows.select("x").distinct().collect()]
    assert sorted(map(tuple, x)) == sorted({tuple(int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v) for v in vectors})
    v = whitening.covariance(rows.select("x").distinct().repartition(5), len(x), np.array(x).sum(0))
    want = exact_covariance(x)
    size = float(max(map(max, want)))
    assert max(abs(float(Fraction(v[i, j]) - want[i][j])) for i in range(9) for j in range(9)) < 4e-16 * size


def test_rows_against_numpy(spark, vectors):
    given = list(enumerate(vectors)) + [(1000, vectors[5]), (1001, None), (1002, [float("nan")] * 9), (1003, [None] * 9), (1004, []), (1005, [float("inf")] * 9), (None, vectors[6])]
    out = whitening.by_component(whitening.whitened(table(spark, given), most=4)).collect()
    assert len(out) == 702 * 4 and {r.key for r in out} == {*range(700), 1000, None}
    x = np.unique(np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000, axis=0)
    n, total = len(x), x.sum(0)
    c = (x - total / n).astype(np.longdouble)
    values, parts = np.linalg.eigh(((c.T @ c) / n).astype(float))
    values, parts = values[::-1], parts[:, ::-1]
    own = {i: np.floor(np.array(v, np.float64) * 64).astype(np.int64) + 1_000_000 for i, v in enumerate(vectors)} | {1000: None}
    own[1000], own[None] = own[5], own[6]
    sign = {}
    for r in out:
        k, mine = r.component - 1, own[r.key]
        want = float((mine - total / n) @ parts[:, k] / np.sqrt(values[k]))
        if abs(want) > 1e-3:
            assert sign.setdefault(k, np.sign(want * r.whitened)) * r.whitened == pytest.approx(want, rel=1e-8)
        assert r.n == n and int(r.deviation) == sum((n * int(v) - int(t)) ** 2 for v, t in zip(mine, total, strict=True))
        assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9
    assert len({r.identity_error for r in out}) == 1


def test_few_rows_and_no_variance(spark):
    one = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert [(r.n, int(r.deviation), r.whitened) for r in one.collect()] == [(1, 0, []), (1, 0, [])] and whitening.by_component(one).count() == 0
    two = whitening.by_component(whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [3.0, 2.0])]))).collect()
    assert sorted((r.key, r.component, r.n, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two) == [(1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (3, 1, 2, 1.0, 1.0)]
    assert whitening.whitened(table(spark, [(1, None)])).count() == 0 and whitening.whitened(table(spark, []).where("false")).count() == 0
    with pytest.raises(ValueError):
        whitening.whitened(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(ValueError):
        whitening.whitened(table(spark, [(1, [1e18]), (2, [0.0])]))


def test_deviations_past_64_bits():
    x, total = np.array([[2**40, -(2**41)], [0, 0]]), np.array([2**40, -(2**41)])
    assert whitening._deviations(x, 2, total) == [2**80 + 2**82] * 2


def test_query(spark, tmp_path):
    out = queries.op13_whitening(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    per = out.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("component").alias("c")).collect()
    assert {(r.n, r.c) for r in per} == {(16, 16)}
    assert out.agg(F.max("identity_error")).first()[0] < 1e-9
