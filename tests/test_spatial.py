import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import spatial


def _all_pairs(x, y, ox, oy, m, radius):
    return [int(m[(a - ox) * (a - ox) + (b - oy) * (b - oy) <= radius * radius].sum()) for a, b in zip(x, y, strict=True)]


def _places(kind, rng, n):
    if kind == "real":
        return rng.uniform(-3, 9, n), rng.uniform(-3, 9, n)
    if kind == "whole":  # many lie exactly on the border
        return rng.integers(-30, 60, n).astype(float), rng.integers(-30, 60, n).astype(float)
    if kind == "rows":
        return np.round(rng.uniform(-3, 9, n), 2), rng.integers(-3, 9, n).astype(float)
    if kind == "line":
        return np.full(n, 1e6), rng.uniform(-3, 9, n)
    return rng.normal(0, 0.01, n) + rng.choice([0.0, 5.0], n), rng.normal(0, 0.01, n)


@pytest.mark.parametrize("held", [50, 1 << 21])
@pytest.mark.parametrize("kind", ["real", "whole", "rows", "line", "clumps"])
def test_counts_by_strips_are_those_of_all_pairs(monkeypatch, kind, held):
    monkeypatch.setattr(spatial, "PLAIN", 10)
    monkeypatch.setattr(spatial, "HELD", held)
    rng = np.random.default_rng(1)
    (x, y), (ox, oy), m = _places(kind, rng, 150), _places(kind, rng, 700), rng.integers(1, 5, 700)
    for radius in (5.0, 13.0):
        assert spatial._within(x, y, ox, oy, m, radius).tolist() == _all_pairs(x, y, ox, oy, m, radius)


def test_counts_by_strips_compare_few_pairs(monkeypatch):
    """Of 4,000 places, of which each has some 800 around it, few are compared one by one."""
    pairs, repeat = [], np.repeat
    monkeypatch.setattr(spatial, "np", type("Counting", (), {"__getattr__": lambda _, name: (lambda a, n: pairs.append(int(n.sum())) or repeat(a, n)) if name == "repeat" else getattr(np, name)})())
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 4, 4000), rng.uniform(0, 4, 4000)
    spatial._within(x, y, x, y, np.ones(4000, int), 1.0)
    assert 0 < sum(pairs) / 2 < 4000 * 400  # all pairs are 4,000 * 4,000, those within a quarter of that


@pytest.mark.parametrize("size", [5, 1 << 16])
def test_crowded_cells_meet_in_parts(spark, monkeypatch, size):
    monkeypatch.setattr(spatial, "SPOTS", size)
    monkeypatch.setattr(spatial, "AROUND", 2 * size)
    monkeypatch.setattr(spatial, "PLAIN", 3)
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-20, 20, (200, 2)))]
    df = spark.createDataFrame([*rows, (900, None, 0.0, 0.0), (901, "a", None, 0.0)], "k int, g string, x double, y double")
    want = {a[0]: sum(a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 25 for b in rows) for a in rows}
    assert {r.k: r.n_near for r in spatial.radius_counts(df, "k", "x", "y", 5.0, "g").collect()} == want


def test_densest_has_a_row_for_each_place(spark, monkeypatch):
    """Places, not rows, are counted and picked from, and counted once, however often the picks read them."""
    counted, run = [], spatial.map_arrow
    seen = spark.sparkContext.accumulator(0)

    def count(df, function, schema):
        def wrapped(batches):
            for out in function(batches):
                seen.add(len(out))
                yield out

        counted.append(1)
        return run(df, wrapped, schema)

    monkeypatch.setattr(spatial, "map_arrow", count)
    at = [(float(i % 7), float(i % 3)) for i in range(420)]
    rows = [(i, "g", x, y) for i, (x, y) in enumerate(at)]
    df = spark.createDataFrame([*rows, rows[5]], "k long, g string, x double, y double")  # a key that is repeated counts as often
    best = spatial.densest(df, "k", "x", "y", 2.0, "g")
    near = lambda a: sum((a[0] - x) ** 2 + (a[1] - y) ** 2 <= 4 for x, y in [*at, at[5]])
    value = {k: near((x, y)) * (2 if k == 5 else 1) for k, _, x, y in rows}
    want = {}
    for k, _, x, y in rows:
        want[x, y] = max(want.get((x, y), (0, 0)), (value[k], k))
    assert {(r.x, r.y): (r.n_near, r.k) for r in best.collect()} == want
    picked = spatial.spread_out(best, "k", "x", "y", "n_near", 4.0, 2, "g")
    first = max((v, k) for k, v in value.items())
    x, y = at[first[1]]
    second = max((v, k) for k, v in value.items() if (at[k][0] - x) ** 2 + (at[k][1] - y) ** 2 > 16)
    assert {r.pick: (r.n_near, r.k) for r in picked.collect()} == {1: first, 2: second}
    assert len(counted) == 1 and seen.value <= 4 * 21  # a place leaves the map once for each part around it
    assert best.agg(F.count("*")).first()[0] == 21
