"""Partial fits and random bases against the exact components."""

import numpy as np
import pytest

from lumenframe.operators import components as P
from lumenframe.operators import vectors


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(0)
    return rng.standard_normal((900, 5)) * [9, 7, 5, 3, 2] @ rng.standard_normal((5, 12)) + 0.05 * rng.standard_normal((900, 12)) + 4


def table(spark, x, odd=()):
    return spark.createDataFrame([(r.tolist(), 1) for r in x] + [(v, 1) for v in odd], "v array<double>, fit int").repartition(20)


def lost(x, mean, parts):
    c = x - mean
    return float(((c - c @ parts.T @ parts) ** 2).sum() / (c**2).sum())


def test_halves_merged_are_one_fit(x):
    one = P.fitted(x, 10)
    halves = P.merged(P.fitted(x[:333], 10), P.fitted(x[333:], 10), 10)
    assert halves.n == one.n and np.allclose(halves.mean, one.mean) and np.allclose(halves.squares, one.squares)
    assert lost(x, *halves.components(5)[:2]) == pytest.approx(lost(x, *one.components(5)[:2]), abs=1e-6)
    again = P.Fit.of(halves.packed())
    assert again.n == 900 and np.array_equal(again.axes, halves.axes)


def test_batches_join_a_short_tail():
    assert P.batches(10, 4, 3) == [(0, 4), (4, 10)] and P.batches(11, 4, 3) == [(0, 4), (4, 8), (8, 11)]
    assert P.batches(3, 4, 5) == [(0, 3)] and P.batches(0, 4, 2) == [] and P.batches(8, 4, 3) == [(0, 4), (4, 8)]


def test_incremental_fit_is_nearly_exact(spark, x):
    df = table(spark, x, odd=[None, [], [float("nan")] * 12, [None] * 12])
    mean, parts, share = P.incremental_fit(df, "v", 5, batch=16).components(5)
    m, p, s = vectors.principal_components(df, "v", 5)
    assert np.allclose(mean, m) and np.abs(parts @ p.T).diagonal() == pytest.approx(np.ones(5), abs=1e-4) and share == pytest.approx(s, rel=1e-4)
    assert lost(x, mean, parts) == pytest.approx(lost(x, m, p), abs=1e-6)
    # micro-batches
    fit = None
    for low in range(0, 900, 300):
        fit = P.incremental_fit(table(spark, x[low : low + 300]), "v", 5, before=fit)
    assert fit.n == 900 and lost(x, *fit.components(5)[:2]) == pytest.approx(lost(x, m, p), abs=1e-6)


def test_random_basis_finds_the_components(spark, x):
    df = table(spark, x, odd=[None])
    mean, parts, share = P.randomised_components(df, "v", 4, over=3, power=4)
    m, p, s = vectors.principal_components(df, "v", 4)
    angles = np.linalg.svd(parts @ p.T)[1]
    assert np.allclose(mean, m) and angles.min() > 1 - 1e-6 and share == pytest.approx(s, rel=1e-4)
    assert np.allclose(parts @ parts.T, np.eye(4))


def test_nothing_to_fit(spark):
    for fit in (lambda df: P.incremental_fit(df, "v", 2), lambda df: P.randomised_components(df, "v", 2)):
        with pytest.raises(ValueError, match="no rows"):
            fit(spark.createDataFrame([(None,)], "v array<double>"))
        with pytest.raises(ValueError, match="differ in length"):
            fit(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"))
    same = P.incremental_fit(spark.createDataFrame([([1.0, 2.0, 3.0],)] * 3, "v array<double>"), "v", 2)
    assert same.n == 3 and len(same.components(2)[1]) == 0


def test_a_flat_spectrum(spark):
    """Leading directions that hardly stand out are found by both ways: nearly all of what the exact ones hold, from many batches."""
    x = np.random.default_rng(9).standard_normal((4000, 64))
    exact = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(8)
    for _, parts, share in (P.incremental_fit(df, "v", 10, batch=256).components(10), P.randomised_components(df, "v", 10)):
        assert share.sum() > 0.98 * exact[:10].sum() / exact.sum()
        assert abs(parts @ parts.T - np.eye(10)).max() < 1e-9
