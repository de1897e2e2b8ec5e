import numpy as np
import pytest

from lumenframe.operators import vectors


def brute(rows, k, metric):
    out = set()
    for a, x in rows:
        found = []
        for b, y in rows:
            if a != b and len(x) == len(y):
                if metric == "cosine":
                    lengths = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
                    d = 1 - ((x * y).sum() / lengths if lengths > 0 else 0.0)
                else:
                    d = np.sqrt(((x - y) ** 2).sum())
                found.append((round(float(d), 9) + 0.0, b))
        out |= {(a, b, rank + 1) for rank, (_, b) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("scale", [1.0, 1e-170])
def test_many_small_blocks_give_what_all_pairs_give(spark, monkeypatch, metric, scale):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "CELL", 2)
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.standard_normal(6) * scale) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(300, np.zeros(6)), (301, np.zeros(6)), (400, np.ones(3) * scale), (401, rng.standard_normal(3) * scale)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id long, v array<double>").repartition(5)
    found = vectors.exact_neighbours(df, "id", "v", 4, metric)
    assert {(r.src, r.dst, r["rank"]) for r in found.collect()} == brute(rows, 4, metric)


def test_copies_are_at_no_distance(spark):
    v = np.random.default_rng(1).standard_normal((40, 64)) * 3
    rows = [(i, v[i % 40].tolist()) for i in range(400)]
    found = vectors.exact_neighbours(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 9, "euclidean").collect()
    assert len(found) == 3600
    assert all(r.distance == 0 and (r.src - r.dst) % 40 == 0 for r in found)


def test_the_search_is_saved_once(spark):
    """What reads the lists several times, as a graph and its reverse, reads files."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, v array<double>")
    plan = vectors.exact_neighbours(df, "id", "v", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "Join" not in plan


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_blocks_meet_in_single_precision(metric, offset, monkeypatch):
    """The product of a later block is made in single precision, unless its rounding is much beside the distances; lists are those of all pairs."""
    kinds, rough = [], vectors._rough
    monkeypatch.setattr(vectors, "_rough", lambda *a: (out := rough(*a)) and kinds.append(out[0].dtype) or out)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 16)) + offset
    x[300] = x[7]
    ids, best = np.arange(600), vectors._Best(200, 5)
    for low in range(0, 600, 200):
        vectors._met(best, ids[:200], x[:200], ids[low : low + 200], x[low : low + 200], metric)
    i, dst, _ = best.kept()
    far = vectors._of_pairs(x, x, *(c.reshape(-1) for c in np.indices((200, 600))), metric).reshape(200, 600)
    far[np.arange(200), np.arange(200)] = np.inf
    want = [np.lexsort((ids, np.round(row, 9)))[:5].tolist() for row in far]
    assert dst.reshape(200, 5).tolist() == want and i.tolist() == np.repeat(np.arange(200), 5).tolist()
    assert [str(k) for k in kinds] == (["float64", "float32", "float32"] if offset == 0 else ["float64"] * 3)


def test_order_of_candidates_is_that_of_all_their_keys():
    rng = np.random.default_rng(9)
    for most in (3, 10**6):
        i, ids, distance = rng.integers(0, 40, 5000), rng.integers(0, 50, 5000), rng.integers(0, most, 5000) / 7
        assert (np.stack([i, distance, ids])[:, vectors._in_order(i, distance, ids)] == np.stack([i, distance, ids])[:, np.lexsort((ids, distance, i))]).all()
