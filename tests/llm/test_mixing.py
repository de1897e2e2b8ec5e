"""The mix against plain Python: targets, streams, blocks, the schedule's evenness."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import mixing, queries
from oracle import assert_equal


def table(spark, rows):
    """Documents of so many words, with columns whose names the operator uses inside."""
    given = [(i, s, None if n is None else " ".join(["w"] * n), 1, 2, 3) for i, s, n in rows]
    return spark.createDataFrame(given, "doc_id long, source string, text string, size long, row long, part long").repartition(3)


def plain_targets(sizes, weights, share):
    """Sources stop one at a time, from the one of least size for its weight on."""
    left, open_ = share * sum(sizes.values()), dict(weights)
    out = {}
    for s in sorted(sizes, key=lambda s: 2 * sizes[s] / weights[s]):
        fair = left * open_[s] / sum(open_.values())
        out[s] = min(2 * sizes[s], fair)
        left -= out[s]
        del open_[s]
    return out


def expected(rows, block):
    rows = [(i, s, n or 0) for i, s, n in rows]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = plain_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5)
    taken, blocks = Counter(), defaultdict(list)
    for s in names:
        stream = []
        for epoch in (0, 1):
            mine = sorted((int(hashlib.md5(f"0:{epoch}:{i}".encode()).hexdigest()[:15], 16), i, n) for i, t, n in rows if t == s)
            stream += [(i, epoch, k) for _, i, n in mine for k in range(n)]
        for at, (i, epoch, k) in enumerate(stream[: math.floor(want[s] + 1e-6)]):
            taken[i] += 1
            blocks[s, at // block].append((i, epoch, k))
    return sizes, want, taken, {k: v for k, v in blocks.items()}


ROWS = [(i, "abcé"[i % 3 if i % 2 else 3], (i * 7) % 23) for i in range(120)] + [(200, None, 50), (201, None, None), (202, "z", 0), (203, "a", 900), (204, "𐀀", 11), (205, "～", 11)]


def test_targets_streams_and_blocks(spark):
    units, planned, mix = mixing.mixed(table(spark, ROWS), block=16)
    sizes, want, taken, blocks = expected(ROWS, 16)
    out = mixing.per_document(units, planned, mix).collect()
    assert len(out) == len(ROWS) and all(r.taken == taken[r.doc] and r.taken <= 2 * r["size"] for r in out)
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) for r in out)
    pieces = mix.collect()
    got = defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r.slot, r["at"])):
        assert r["at"] == len(got[r.slot])
        got[r.slot] += [(r.source, r.doc, r.epoch, r.start + k) for k in range(r.length)]
    rank = Counter()
    for slot in sorted(got):
        s = got[slot][0][0]
        assert [x[1:] for x in got[slot]] == blocks[s, rank[s]] and {x[0] for x in got[slot]} == {s}
        rank[s] += 1
    assert len(got) == len(blocks)


def test_any_stretch_of_the_schedule_is_even(spark):
    blocks = {0: 600, 1: 250, 2: 100, 3: 49, 4: 1}
    rows = spark.createDataFrame([(k % 2, k, n) for k, n in blocks.items()], "part int, number int, blocks int").sort("part", "number")
    rows = rows.withColumn("part", F.when(F.col("number") < 2, 0).otherwise(1))
    out = sorted((r.slot, r.number, r.block) for r in mixing.schedule(rows).collect())
    assert Counter(n for _, n, _ in out) == blocks and len({s for s, _, _ in out}) == 1000
    for k, n in blocks.items():
        assert [b for _, m, b in out if m == k] == list(range(n))
    seen = Counter()
    for i, (_, n, _) in enumerate(out, 1):
        seen[n] += 1
        assert all(abs(seen[k] - i * blocks[k] / 1000) < 4 for k in blocks)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.99, 2.0, 3.0])
def test_shares(spark, share):
    rows = [(i, f"s{i % 7}", 1 + i % 11) for i in range(70)]
    units, planned, mix = mixing.mixed(table(spark, rows), share=share, block=8)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = plain_targets(sizes, {f"s{k}": (5, 2, 1)[k % 3] for k in range(7)}, min(share, 2))
    taken = {r.source: r.n for r in mix.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    for r in planned.collect():
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert taken.get(r.source, 0) in (math.floor(want[r.source] - 1e-6), math.floor(want[r.source] + 1e-6))


def test_reruns_and_partitions_agree(spark):
    one = mixing.mixed(table(spark, ROWS), block=16)[2].drop("row").collect()
    two = mixing.mixed(table(spark, ROWS[::-1]).repartition(7), block=16)[2].drop("row").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_repeated_ids_and_empty_tables(spark):
    same = [(1, "a", 5)] * 6 + [(2, "b", 4), (None, "b", 4)]
    units, planned, mix = mixing.mixed(table(spark, same))
    out = mixing.per_document(units, planned, mix).collect()
    assert len(out) == 8 and sum(r.taken for r in out) == sum(math.floor(r.target) for r in planned.collect())
    assert all(r.taken <= 2 * r["size"] for r in out)
    for rows in ([], [(1, None, None), (2, "a", 0)]):
        units, planned, mix = mixing.mixed(table(spark, rows))
        assert mix.count() == 0 and [r.taken for r in mixing.per_document(units, planned, mix).collect()] == [0] * len(rows)


def test_one_long_document(spark):
    units, planned, mix = mixing.mixed(table(spark, [(1, "a", 300_000), (2, "b", 100)]), block=64)
    assert {r.doc: r.taken for r in mixing.per_document(units, planned, mix).collect()} == {1: 449_950, 2: 200}


def test_query(spark):
    assert_equal(spark, queries.op12_mixing, queries.ORACLES["op12_mixing"])


def test_no_python_on_the_way(spark):
    units, planned, mix = mixing.mixed(table(spark, ROWS))
    plan = mixing.per_document(units, planned, mix)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
