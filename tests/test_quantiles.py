"""Exact quantiles by rank against numpy's."""

import numpy as np
import pytest

from lumenframe.operators import quantiles as Q

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_are_numpys(spark, parts):
    rng = np.random.default_rng(0)
    rows = [(["a", "b", None][int(rng.integers(0, 3))], 1, float(rng.integers(0, 40) if i % 2 else rng.standard_normal())) for i in range(900)]
    rows += [("hot", 2, 7.0)] * 3000 + [("one", 1, -1.5), ("none", 1, None), ("a", 1, None), ("two", 0, 1.0), ("two", 0, 2.0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        df = spark.createDataFrame(rows, "k string, part int, m double")
        out = {r.k: r.q for r in Q.quantiles(df, ["k"], "m", SHARES).collect()}
        both = Q.quantiles(df, ["k", "part"], "m", [0.5]).collect()
        total = Q.quantiles(df, [], "m", SHARES).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {k for k, _, v in rows if v is not None}
    assert set(out) == groups
    for k in groups:
        assert out[k] == pytest.approx(np.quantile([v for g, _, v in rows if g == k and v is not None], SHARES).tolist(), abs=1e-12)
    assert len(both) == len({(k, p) for k, p, v in rows if v is not None})
    assert total[0].q == pytest.approx(np.quantile([v for *_, v in rows if v is not None], SHARES).tolist(), abs=1e-12)


def test_nothing_and_odd_shares(spark):
    df = spark.createDataFrame([(1, None)], "k int, v double")
    assert Q.quantiles(df, ["k"], "v", [0.5]).count() == 0 and Q.quantiles(df.limit(0), [], "v", [0.5]).count() == 0
    assert spark.range(1).select(Q.median(df, "v")).first()[0] is None
    with pytest.raises(ValueError):
        Q.quantiles(df, [], "v", [1.5])


def test_tables_side_by_side(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, n int")
    b = spark.createDataFrame([(None, 5), ("x", 6)], "k string, q int")
    assert sorted((str(r.k), r.n, r.q) for r in Q.beside(a, b, ["k"]).collect()) == [("None", 1, 5), ("x", 2, 6), ("y", 3, None)]
