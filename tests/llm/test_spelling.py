"""Spelling variants against brute force: every pair of words compared."""

import numpy as np
import pytest

from lumenframe.llm import queries, spelling
from oracle import assert_equal


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts, ratio):
    total = {}
    for w, n in counts:
        if w is not None and n is not None:
            total[w] = total.get(w, 0) + n
    forms, rows = {}, {}
    for w, n in total.items():
        others = [(-total[v], v.encode("utf-32-be"), v) for v in total if near(w, v)]
        best = min(others)[2] if others else None
        forms[w] = best if best is not None and total[best] >= ratio * n else None
        rows[w] = (n, len(others), total[best] if forms[w] is not None else None)
    for w in rows:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows[w] = (forms[w], root, *rows[w])
    return rows


def found(spark, counts, ratio=5):
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in counts], "word string, n long, form string, rank int").repartition(3)
    out = spelling.variants(df, ratio).collect()
    assert len({r.word for r in out}) == len(out)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}


@pytest.mark.parametrize("seed", range(3))
def test_variants_are_those_of_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list("abé"), rng.integers(0 if seed else 1, 6))) for _ in range(150)}
    counts = [(w, int(10 ** rng.uniform(0, 4))) for w in sorted(words)]
    counts += [(None, 7), ("b", None), counts[3], counts[3]]  # nulls, repeated words
    assert found(spark, counts) == expected(counts, 5)
    assert found(spark, counts, 2) == expected(counts, 2)


def test_ties_chains_and_code_point_order(spark):
    # ties go to the smaller word: "z" is before "é"; U+FF5E is before U+10000, unlike in UTF-16
    counts = [("abcdef", 5), ("abcdez", 30), ("abcdeé", 30), ("abcdezq", 200), ("abcdezqq", 2000), ("xy\U00010000", 50), ("xy～", 50), ("xy", 1)]
    out = found(spark, counts)
    assert out == expected(counts, 5)
    assert out["abcdef"] == ("abcdez", "abcdezqq", 5, 2, 30)
    assert out["xy"][0] == "xy～"


def test_very_long_words_and_runs_of_a_letter(spark):
    long = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 30_000))
    words = [(long, 100), (long[:17_000] + long[17_001:], 10), (long[:29_999] + "z", 20), (long[::-1], 9), ("a" * 50_000, 8), ("a" * 49_999, 80), ("a" * 49_998, 3)]
    out = found(spark, words)
    assert [out[w][3] for w, _ in words] == [2, 1, 1, 0, 1, 2, 1]
    assert out[words[1][0]][0] == long and out[words[4][0]][1] == "a" * 49_999 and out[words[6][0]][4] == 80


def test_a_crowded_key(spark):
    """All words of a deletion: nothing depends on how many share a key."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    counts = [(f"abc{x}ef", 5 + i) for i, x in enumerate(letters)]
    out = found(spark, counts)
    assert all(v[3] == 2999 for v in out.values())
    assert out[counts[0][0]][:2] == (counts[-1][0], counts[-1][0]) and out[counts[-1][0]][0] is None


def test_runs_of_letters(spark):
    df = spark.createDataFrame([(1, "Ab×C é1Z-zz ÀB"), (2, None), (3, ""), (4, "12 ~"), (4, "x"), (4, "x")], "doc_id long, text string")
    assert sorted(r.word for r in spelling.runs(df).collect()) == sorted(["ab×c", "é", "z", "zz", "Àb", "x", "x"])
    assert sorted(r.word for r in spelling.runs(df, least=2).collect()) == sorted(["ab×c", "zz", "Àb"])
    assert [tuple(r) for r in spelling.counted(spelling.runs(df), 1, 2).collect()] == [("x", 2)]


def test_no_words(spark):
    assert found(spark, []) == {} and found(spark, [(None, None)]) == {}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"), 1)


def test_query(spark):
    assert_equal(spark, queries.op11_spelling, queries.ORACLES["op11_spelling"])
