"""Answers for context limits that are nobody's length."""

import numpy as np
import pytest

from lumenframe.llm import token_counts


def table_of(spark, lengths):
    values, counts = np.unique(lengths, return_counts=True)
    rows = [(int(v), int(c), int(v * c)) for v, c in zip(values, counts, strict=True)]
    return token_counts.suffix_table(spark.createDataFrame(rows, "length long, n_docs long, n_tokens long"))


@pytest.mark.parametrize("block", [256, 3])
def test_any_limit(spark, monkeypatch, block):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    rng = np.random.default_rng(0)
    lengths = np.concatenate([rng.integers(0, 60, 200), [0, 7, 900, 900, 5000]])
    asked = [*range(70), 255, 256, 257, 899, 900, 901, 4999, 5000, 5001, 10**9, 7, 7]
    limits = spark.createDataFrame([(x, "k", 0) for x in asked] + [(None, "k", 0), (-1, "k", 0)], "limit long, n_docs string, length int")
    got = token_counts.for_limits(table_of(spark, lengths), limits).collect()
    assert sorted(r.limit for r in got if r.limit is not None) == sorted([*asked, -1]) and len(got) == len(asked) + 2
    for r in got:
        if r.limit is None or r.limit < 0:
            assert r.n_docs is None and r.lost is None and r.quantile is None
            continue
        assert r.n_docs == (lengths == r.limit).sum() and r.docs_longer == (lengths > r.limit).sum()
        assert r.truncated_total == np.minimum(lengths, r.limit).sum() and r.lost == lengths.sum() - r.truncated_total
        assert (r.total_docs, r.total_tokens) == (len(lengths), lengths.sum()) and r.quantile == pytest.approx((lengths <= r.limit).mean())


def test_no_documents_and_no_limits(spark):
    none = table_of(spark, np.array([1])).where("false")
    (row,) = token_counts.for_limits(none, spark.createDataFrame([(5,)], "limit long")).collect()
    assert (row.total_docs, row.truncated_total, row.docs_longer, row.quantile) == (0, 0, 0, None)
    assert token_counts.for_limits(none, spark.createDataFrame([], "limit long")).count() == 0
