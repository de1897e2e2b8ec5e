"""The text operators against brute force, on hand-made rows: nulls, empties, long texts, ties, repeats, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import ann, components, decontaminate, kernels, lines, minhash, packing, pii, quality, queries, repeats, sais, substrings, suffixes, token_counts, tokens, work
from lumenframe.llm.fm_index import FmIndex
from oracle import assert_equal

SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, found string, start string, hit string"


def docs(spark, texts):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "f", "s", "h") for i, t in texts], DOCS).repartition(3, "doc_id")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def corpus(seed=0):
    """Small texts with exact and near copies, shared passages, nulls, empties and one long text."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeéß"), rng.integers(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, out = say(30), []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            t = say(int(rng.integers(0, 60)))
        elif kind == 1:
            t = f"{say(5)} {passage}\n{say(7)}"
        elif kind == 2:
            t = out[-2][1] or ""
        elif kind == 3:
            w = (out[-3][1] or "x").split(" ")
            w[len(w) // 2] = word()
            t = " ".join(w)
        elif kind == 4:
            t = " ".join([word()] * 40)
        else:
            t = say(3)
        out.append((i, t))
    return [*out, (60, None), (61, ""), (62, " \n\t "), (63, say(4000)), (64, passage), (65, passage)]


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_repeated_words_take_little_memory():
    """20,000 equal words against 5,000: 10^8 pairs of a suffix and a place, of which none is held."""
    import tracemalloc

    from lumenframe.llm import kernels

    items = decontaminate.Items(["x", "y"], ["a " * 5000, "b a b"], 10)
    data, offsets = kernels.utf8(__import__("pyarrow").array(["a " * 20_000, "c " + "a " * 30], "large_string"))
    for longest in (False, True):
        tracemalloc.start()
        n, spans, of, *matches = decontaminate._search(items, data, offsets, None, longest)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300e6 and n.to_pylist() == [20_000, 31] and of.to_pylist() == [["x"], ["x"]]
        assert spans.to_pylist() == [[{"start": 0, "end": 20_000}], [{"start": 1, "end": 31}]]
    found = {(m["item_start"], m["start"]): m["length"] for m in matches[0].to_pylist()[0]}
    assert found == {(0, p): min(5000, 20_000 - p) for p in range(19_991)} | {(i, 0): 5000 - i for i in range(4991)}


def test_a_passage_of_many_items_and_texts():
    from lumenframe.llm import kernels

    words = [f"w{i}" for i in range(300)]
    items = decontaminate.Items([str(i) for i in range(60)], [" ".join([f"i{i}", *words, f"z{i}"]) for i in range(60)], 10)
    texts = [" ".join([f"t{i}", *(words if i % 3 else words[:50]), f"u{i}"]) for i in range(90)]
    data, offsets = kernels.utf8(__import__("pyarrow").array(texts, "large_string"))
    n, spans, of = decontaminate._search(items, data, offsets, None, False)
    assert all(x == sorted(str(i) for i in range(60)) for x in of.to_pylist())
    assert [s[0] for s in spans.to_pylist()] == [{"start": 1, "end": 301 if i % 3 else 51} for i in range(90)]


def test_empty_tables(spark):
    none = docs(spark, [(1, "x")]).where("doc_id > 1")
    items = spark.createDataFrame([], "item_id long, text string")
    path = queries.tokenizer_path()
    assert packing.pack(none, path).count() == 0 and token_counts.length_table(none, path).count() == 0
    assert decontaminate.report(none, items).count() == 0
    assert minhash.near_duplicates(none).count() == 0 and lines.drop_repeated_lines(none).count() == 0
    assert substrings.drop_repeated_passages(none).count() == 0 and suffixes.drop_repeated_bytes(none).count() == 0
    assert pii.replace_entities(none, "k").count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(none, labels).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors, vectors).count() == 0


def test_tokens_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    slow, fast = Tokenizer.from_file(path), tokens.encoder(path)
    for t in ["", "a", "don't 'tis 1234  x \n\n y", "é ß 漢字 <|endoftext|> z", " " * 50 + "a" * 300, "\r\n\t"]:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("budget", [64, 2048])
def test_packing_is_a_partition_of_all_ids(spark, texts, budget):
    path = queries.tokenizer_path()
    encode = tokens.encoder(path)
    got = packing.pack(docs(spark, texts), path, budget=budget, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in texts:
        ids = [*encode(t or "").tolist(), 1]
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert sum((r.ids for r in parts), []) == ids and all(r.doc_tokens == len(ids) for r in parts)
        for r in parts:
            assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= budget
    total = sum(r.length for r in got)
    padding = sum(0 if (n & (n - 1)) == 0 else budget - n for n in (sum(r.length for r in p) for p in by_sequence.values()))
    assert budget > 64 or padding < 0.2 * total


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        position = np.concatenate([[0], np.cumsum(rng.integers(1, 60, rng.integers(1, 25)))])
        penalty = rng.integers(0, 40, len(position))
        cost = [0] + [10**9] * (len(position) - 1)
        for j in range(1, len(position)):
            for i in range(j):
                n = int(position[j] - position[i])
                if n <= 128:
                    free = n & (n - 1) == 0 and n >= packing.SHORTEST_POWER
                    cost[j] = min(cost[j], cost[i] + (0 if free else 128 - n) + int(penalty[j]) + packing.SEQUENCE_PRICE)
        cuts = packing.plan_cuts(position, penalty, 128)
        lengths = np.diff(position[cuts])
        mine = sum((0 if n & (n - 1) == 0 and n >= packing.SHORTEST_POWER else 128 - n) + packing.SEQUENCE_PRICE for n in lengths.tolist()) + int(penalty[cuts[1:]].sum())
        assert mine == cost[-1]


def test_token_histogram(spark, texts):
    encode = tokens.encoder(queries.tokenizer_path())
    lengths = np.array([len(encode(t or "")) for _, t in texts])
    got = token_counts.length_table(docs(spark, texts), queries.tokenizer_path()).collect()
    assert sorted(r.length for r in got) == sorted(set(lengths.tolist()))
    for r in got:
        assert r.n_docs == (lengths == r.length).sum() and r.docs_at_least == (lengths >= r.length).sum() and r.tokens_at_least == lengths[lengths >= r.length].sum()
        assert r.truncated_total == np.minimum(lengths, r.length).sum() and r.total_tokens == lengths.sum() and r.quantile == pytest.approx((lengths <= r.length).mean())


def overlaps_by_force(words, items, width=10):
    """(hit places, item names, maximal matches) of a text's words."""
    hit, names, matches = set(), set(), set()
    for name, text in items:
        x = ALNUM.findall(lower(text or ""))
        n = min(width, len(x))
        for a in range(len(x) - n + 1) if n else ():
            for b in range(len(words) - n + 1):
                if words[b : b + n] == x[a : a + n]:
                    hit.update(range(b, b + n))
                    names.add(name)
                    if not a or not b or x[a - 1] != words[b - 1]:
                        size = n
                        while a + size < len(x) and b + size < len(words) and x[a + size] == words[b + size]:
                            size += 1
                        matches.add((name, a, b, size))
    return hit, names, matches


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, texts, block):
    items = [(1, texts[64][1]), (2, "abc"), (3, None), (4, ""), (None, " ".join(texts[63][1].split(" ")[5:30])), (6, texts[64][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = docs(spark, texts).withColumn("spans", F.lit("mine")).withColumn("the_text", F.lit("x"))
    found = {r.doc_id: r for r in decontaminate.report(rows, benchmark, block_bytes=block).collect()}
    named = [("null" if i is None else str(i), t) for i, t in items]
    for i, t in texts:
        w = ALNUM.findall(lower(t or ""))
        hit, names, matches = overlaps_by_force(w, named)
        r = found[i]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(names), bool(hit))
        assert sorted(tuple(m) for m in r.matches) == sorted(matches)
    clean = decontaminate.remove_contaminated(rows, benchmark, block_bytes=block)
    assert clean.columns == rows.columns and clean.count() == sum(not r.contaminated for r in found.values())
    assert {(r.spans, r.the_text) for r in clean.collect()} == {("mine", "x")}


def shingles(t, k):
    w = SPACE.findall(lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_by_force(texts, k):
    """The smallest id that each text reaches over links."""
    sets = {i: shingles(t, k) for i, t in texts}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, texts, k):
    root = components_by_force(texts, k)
    frame = docs(spark, [*texts, (None, "a b c")]).withColumn("the_id", F.lit("x"))
    out = {r.doc_id: r for r in minhash.near_duplicates(frame, shingle=k).collect()}
    assert (out[None].component_id, out[None].kept) == (None, True)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in out.items() if i is not None} == {i: (len(shingles(t, k)), root[i], root[i] == i) for i, t in texts}
    left = minhash.keep_one(frame, shingle=k)
    assert {r.doc_id for r in left.collect()} == {i for i in root if root[i] == i} | {None} and left.columns == frame.columns
    with pytest.raises(ValueError, match="integer"):
        minhash.near_duplicates(frame.withColumn("doc_id", F.lit("x")))


def test_near_duplicates_of_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (3, "a b c d e f"), (4, None), (4, None)]
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows), shingle=2).collect())
    assert out == [(1, 5, 1), (1, 5, 1), (2, 5, 1), (3, 5, 1), (4, 0, 4), (4, 0, 4)]


def test_near_duplicates_of_a_broken_up_group(spark):
    """Copies at all distances: buckets with several components are compared until none is left open."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for j in rng.choice(80, rng.integers(1, 14), replace=False):
            w[j] = f"x{i}-{j}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 2) for i, t in rows}
    parent = {i: i for i in sets}
    root = lambda i: i if parent[i] == i else root(parent[i])
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), shingle=2).collect()}
    assert out == {i: root(i) for i in sets}


def test_similar_pairs_of_many_small_sets():
    """Short texts with a shingle in common: no more memory than their candidates need, and the same pairs as by trying all."""
    rng = np.random.default_rng(4)
    sets = [np.unique(np.append(rng.integers(0, 400, int(rng.integers(1, 9))), 7)).astype(np.uint64) for _ in range(160)]
    sets += [np.unique(np.append(s[:-1], np.uint64(900 + i))) for i, s in enumerate(sets[:60])]
    x, y = sets[:70], sets[70:]
    packed = lambda s: (np.concatenate(s), np.concatenate([[0], np.cumsum([len(z) for z in s])]))
    got = set(zip(*(z.tolist() for z in minhash.similar_pairs(packed(x), packed(y), 80)), strict=True))
    assert got == {(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (7, 7)], "u long, v long")
    out = {r.node: r.component for r in components.components(links, work.Workspace(spark, "test")).collect()}
    assert out == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50}


def clashing(df):
    """With columns named like results and like what the operators might use inside."""
    for c in ("the_text", "the_key", "the_found", "__text", "__key"):
        df = df.withColumn(c, F.lit("x"))
    return df.withColumn("n_removed", F.lit("mine"))


def removed_words(texts):
    """Of each text which words go, by trying all windows."""
    first, gone = {}, {}
    for i, t in sorted(texts):
        w = SPACE.findall(t or "")
        gone[i] = set()
        for a in range(len(w) - 12):
            if first.setdefault(tuple(w[a : a + 13]), i) < i:
                gone[i].update(range(a, a + 13))
    return gone


def maximal_runs(at):
    """Sorted positions as (start, length)."""
    out = []
    for a in sorted(at):
        if out and sum(out[-1]) == a:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((a, 1))
    return out


@pytest.mark.parametrize("split", [1, 20_000])
def test_repeated_passages(spark, texts, split):
    gone = removed_words(texts)
    rows = clashing(docs(spark, [*texts, (None, texts[64][1])]))
    result = substrings.drop_repeated_passages(rows, split=split)
    assert result.columns == [c for c in rows.columns if c != "n_removed"] + substrings.RESULTS
    out = {r.doc_id: r for r in result.collect()}
    assert out[None].n_removed == 0
    for i, t in texts:
        w = SPACE.findall(t or "")
        kept = " ".join(x for a, x in enumerate(w) if a not in gone[i])
        assert (out[i].n_words, out[i].n_removed, out[i].kept, out[i].hit, out[i].the_text) == (len(w), len(gone[i]), kept, "h", "x")
        assert [tuple(s) for s in out[i].spans] == maximal_runs(gone[i])


def test_words_of_equal_hash_are_told_apart(spark):
    """Pairs of 13 words that differ in one: words are compared by their bytes, whatever their 32-bit hashes."""
    pairs = [("v114523", "v147406"), ("v1", "v2"), ("x" * 50 + "a", "x" * 50 + "b")]
    rows = []
    for k, (a, b) in enumerate(pairs):
        for j, w in enumerate((a, b)):
            rows.append((2 * k + j, " ".join([f"p{k}n{i}" for i in range(6)] + [w] + [f"q{k}n{i}" for i in range(6)])))
    assert all(r.n_removed == 0 for r in substrings.drop_repeated_passages(docs(spark, rows)).collect())


def removed_bytes(rows, length):
    times, out = {}, {}
    for _, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            times[b[a : a + length]] = times.get(b[a : a + length], 0) + 1
    for i, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1):
            if times[b[a : a + length]] > 1:
                hit[a : a + length] = True
        out[i] = (b, hit)
    return out


@pytest.mark.parametrize("split", [1, 20_000])
def test_repeated_bytes(spark, texts, split):
    rows = [*texts, (None, texts[1][1]), (70, "ab" * 400), (71, "é" * 150)]
    out = {r.doc_id: r for r in suffixes.drop_repeated_bytes(clashing(docs(spark, rows)), length=100, gram=24, split=split).collect()}
    for i, (b, hit) in removed_bytes(rows, 100).items():
        runs = maximal_runs(np.flatnonzero(hit).tolist())
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans, bytes(out[i].kept)) == (len(b), hit.sum(), len(runs), bytes(x for a, x in enumerate(b) if not hit[a]))
        assert [tuple(s) for s in out[i].spans] == runs


def test_segments_that_only_share_their_key_gram_are_not_indexed():
    rng = np.random.default_rng(5)
    scheme = repeats.Scheme(words=False, length=60, gram=16)
    text = lambda n: rng.integers(97, 123, n).astype(np.uint8)
    for _ in range(200):
        base = text(120)  # the gram stands at 50 to 66 in all of them
        blobs, n = [], []
        for _ in range(int(rng.integers(2, 6))):
            left, right = (int(x) for x in rng.integers(0, 44, 2))
            own = text(120)
            own[50 - left : 66 + right] = base[50 - left : 66 + right]
            blobs.append(own[int(rng.integers(0, 20)) : 120 - int(rng.integers(0, 20))])
            n.append(int(rng.integers(1, 3)))
        data, bounds = np.concatenate(blobs), np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
        shard = np.full(len(n), kernels.signed(scheme.grams(base[50:66]))[0])
        asked = scheme.undecided(shard, np.array(n), data, bounds)
        windows = [{bytes(b[i : i + 60]) for i in range(len(b) - 59)} for b in blobs]
        meets = lambda i, j: i != j and min(n[i], n[j]) == 1 and windows[i] & windows[j]  # noqa: B023, E731
        assert all(asked[i] for i in range(len(n)) for j in range(len(n)) if meets(i, j))
    apart = [np.concatenate([text(44), base[50:66], text(44)]) for _ in range(3)]
    shard = np.full(3, shard[0])
    assert not scheme.undecided(shard, np.ones(3, int), np.concatenate(apart), np.arange(4) * 104).any()


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for trial in range(300):
        s = rng.integers(0, int(rng.choice([1, 2, 3, 50])), int(rng.integers(0, 60)))
        if trial % 3 == 0 and len(s):
            s = np.tile(s[: max(1, len(s) // 4)], 4)
        t = s.tolist()
        array = sais.suffix_array(s)
        assert array.tolist() == sorted(range(len(t)), key=lambda i: t[i:])  # noqa: B023
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(4000)]
    s = np.frombuffer(" ".join(rng.choice(words, 20_000)).encode(), np.uint8).astype(np.uint16)
    array, b = sais.suffix_array(s), s.astype(np.uint8).tobytes()
    assert array.tolist() == sorted(range(len(b)), key=lambda i: b[i : i + 400])
    prefix = sais.permuted_lcp(s, array)
    for k in rng.integers(1, len(s), 300).tolist():
        x, y = b[array[k - 1] :], b[array[k] :]
        assert prefix[array[k]] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(40):
        strings = [rng.integers(1, 5, int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 12)))]
        fm = FmIndex(np.concatenate(strings), np.concatenate([[0], np.cumsum([len(x) for x in strings])]))
        patterns = np.array([x[a : a + 3] for x in strings for a in range(len(x) - 2)]).reshape(-1, 3)
        if len(patterns):
            for p, low, high in zip(patterns, *fm.search(patterns[:, j] for j in (2, 1, 0)), strict=True):
                want = [i for i, x in enumerate(strings) for a in range(len(x) - 2) if (x[a : a + 3] == p).all()]
                assert sorted(fm.locate(np.arange(low, high)).tolist()) == want


def test_repeated_lines(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, None), (4, ""), (5, "a\nb"), (6, "q\nq\nq\nq\nq"), (None, "a\nb\nc"), (7, "b\nc\nd\n")]
    frame = clashing(docs(spark, rows)).withColumn("the_gone", F.lit("x"))
    result = lines.drop_repeated_lines(frame)
    assert result.columns == [c for c in frame.columns if c != "n_removed"] + lines.RESULTS
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in result.collect()}
    assert out == {1: ("a\nb\nc\nd", 4, 0), 2: ("x\ny", 5, 3), 3: (None, 0, 0), 4: ("", 1, 0), 5: ("a\nb", 2, 0), 6: ("q", 5, 4), None: ("a\nb\nc", 3, 0), 7: ("", 4, 3)}
    twice = lines.drop_repeated_lines(docs(spark, [(1, "a\nb\nc"), (1, "a\nb"), (0, "a\nb\nc")]))
    assert sorted((r.doc_id, r.text, r.n_removed) for r in twice.collect()) == [(0, "a\nb\nc", 0), (1, "", 2), (1, "", 3)]  # rows of one id lose the same lines
    with pytest.raises(ValueError, match="integer"):
        lines.drop_repeated_lines(frame.withColumn("doc_id", F.lit("x")))


def cipher_by_hand(kind, key, unit, low, high):
    """The surrogate of a unit in plain Python: the last letter or digit first, then the others from left to right."""
    digest = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    known = (lambda x: re.sub("[^0-9]", "", x)) if kind in ("phone", "number") else str.lower
    classes = pii._classes(kind) + (pii._other_letters() if kind == "person" else [])
    counts = (lambda c: c.isalpha()) if kind == "person" else (lambda c: c.isascii() and c.isalnum()) if kind in ("email", "secret") else (lambda c: c in "0123456789")

    def moved(c, amount):
        s = next((s for s in classes if c in s), None)
        return c if s is None else s[(s.index(c) + amount(len(s))) % len(s)]

    p = max((i for i in range(high) if counts(unit[i])), default=None)
    p = max(i for i in range(len(unit)) if counts(unit[i])) if p is None else p
    rest = known(unit[:p] + "|" + unit[p + 1 :])
    z = moved(unit[p], lambda n: 1 + digest(f"{key}{kind} last:{rest}") % (n - 1))
    return "".join(z if i == p else moved(c, lambda n: digest(f"{key}{kind}:{z.lower()}:{known(unit[:i])}")) if low <= i < high else c for i, c in enumerate(unit))  # noqa: B023


def name_by_hand(key, word):
    return cipher_by_hand("person", key, word, 0, len(word) - (len(word) > 2))


def test_surrogates(spark):
    text = "Mrs Anna Lee <anna.lee@mail.example.org>, +1 (743) 555-3824, 10.0.0.255, 4111 1111 1111 1111, token=24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, text), (2, f"again {text}"), (3, None), (4, ""), (5, "plain 12 words"), (6, "ANNA.LEE@MAIL.EXAMPLE.ORG +1-743-555-3824"), (7, "10.0.0.254 10.0.0.255")]
    frame = clashing(docs(spark, rows)).withColumn("entities", F.lit("mine"))
    result = pii.replace_entities(frame, "secret1")
    assert result.columns == [c for c in frame.columns if c != "entities"] + ["entities"]
    out = {r.doc_id: r for r in result.collect()}
    assert out[2].text == f"again {out[1].text}" and out[5].text == "plain 12 words" and out[3].text is None and out[4].text == ""
    assert len(out[1].entities) == 6 and not any(e in out[1].text for e in out[1].entities)
    k = "secret1"
    assert out[1].text == (
        f"Mrs {name_by_hand(k, 'Anna')} {name_by_hand(k, 'Lee')} <{cipher_by_hand('email', k, 'anna.lee@mail.example.org', 0, 21)}>, "
        f"{cipher_by_hand('phone', k, '+1 (743) 555-3824', 2, 17)}, {out[1].text.split(', ')[2]}, {cipher_by_hand('number', k, '4111 1111 1111 1111', 0, 19)}, "
        f"token={cipher_by_hand('secret', k, '24be64439e3e49cf46b2d7c90f3602a3d0b907ff', 0, 40)}"
    )
    assert re.fullmatch(r"Mrs [A-Z][a-z]{3} [A-Z][a-z]{2} <[a-z]{4}\.[a-z]{3}@[a-z]{4}\.[a-z]{7}\.org>, \+1 \(\d{3}\) \d{3}-\d{4}, [\d.]+, \d{4} \d{4} \d{4} \d{4}, token=[0-9a-f]{40}", out[1].text)
    assert out[6].text.split()[0].lower() in out[1].text and re.sub(r"\D", "", out[6].text) in re.sub(r"\D", "", out[1].text)
    assert all(int(x) < 256 for a in out[7].text.split() for x in a.split(".")) and len(set(out[7].text.split())) == 2
    assert out[7].text.split()[1] in out[1].text
    audit = pii.audit(docs(spark, rows), "secret1").first()
    assert audit.collisions == 0 and audit.n_unchanged == 0 and audit.n_distinct == audit.n_surrogates


def test_a_name_has_one_surrogate(spark):
    found = ["Mr Smith", "Mrs Smith", "Mr John Smith", "John Smith-Jones", "Dr. Anna Smith", "Anna Jones", "Mr Łść", "Mr Ծով", "Господин Смит"]
    out = {r.doc_id: r.text for r in pii.replace_entities(docs(spark, list(enumerate(found))), "example").collect()}
    smith, john, anna, jones = (name_by_hand("example", w) for w in ("Smith", "John", "Anna", "Jones"))
    assert [out[i] for i in range(6)] == [f"Mr {smith}", f"Mrs {smith}", f"Mr {john} {smith}", f"{john} {smith}-{jones}", f"Dr. {anna} {smith}", f"{anna} {jones}"]
    assert len({smith, john, anna, jones, "Smith", "John", "Anna", "Jones"}) == 8 and all(w[-1] == s[-1] for w, s in (("Smith", smith), ("Anna", anna)))
    for i, word in ((6, "Łść"), (7, "Ծով"), (8, "Смит")):
        new = out[i].split()[1]
        assert new != word and new[0].isupper() and new[1:].islower() and pii.unicodedata.name(new[0]).split()[0] == pii.unicodedata.name(word[0]).split()[0]


def test_no_surrogate_is_another_unit(spark):
    first = name_by_hand("example", "Smith")
    rows = [(1, "Mr Smith and a@b.org"), (2, f"Mrs {first}"), (3, f"Mr Smith, Mr {first}, {cipher_by_hand('email', 'example', 'a@b.org', 0, 3)}"), (4, "nothing"), (5, None), (1, "Mr Smith and a@b.org")]
    frame = docs(spark, rows).withColumn("the_map", F.lit("x"))
    out = sorted(((r.doc_id, r.text) for r in pii.replace_entities(frame, "example").collect()), key=str)
    new = dict(out)
    smith = name_by_hand("example1", "Smith")
    assert len(out) == 6 and new[2] == f"Mrs {name_by_hand('example', first)}" and new[3].startswith(f"Mr {smith}, Mr {name_by_hand('example', first)}, ") and new[4] == "nothing" and new[5] is None
    assert [t for i, t in out if i == 1] == [f"Mr {smith} and {cipher_by_hand('email', 'example1', 'a@b.org', 0, 3)}"] * 2
    audit = pii.audit(frame, "example").first()
    assert (audit.collisions, audit.n_unchanged, audit.n_real) == (0, 0, 0)


def test_no_surrogate_is_its_entity(spark):
    consonants, vowels = "bcdfghjklmnpqrstvwxz", "aeiouy"
    names = [(c + v).capitalize() for c in consonants + vowels for v in vowels] + ["Ng", "Łę", "Ææ", "Ђђ", "Ёё", "Աբ", "Øß"]
    found = [f"{t} {n}" for t in ("Mrs.", "Frau.") for n in names] + ["deadbeef" * 4, "AbCdEf" * 6, "_@-.com", "1.2.3.4", "1.2.3.5", "+1 (555) 123-4567", "1234 5678 9012 3456", "123-45-6789", "AKIA" + "A1" * 8]
    out = {r.doc_id: r for r in pii.replace_entities(docs(spark, list(enumerate(found))), "example").collect()}
    assert all(out[i].entities == [e] and out[i].text != e for i, e in enumerate(found))
    assert len({r.text for r in out.values()}) == len(found)
    assert all(out[i].text.split()[0] == e.split()[0] and out[i].text.istitle() for i, e in enumerate(found) if " " in e and e[0] in "MF")
    audit = pii.audit(docs(spark, list(enumerate(found))), "example").first()
    assert audit.n_unchanged == 0 and audit.collisions == 0


def grams_by_force(t):
    words = ALNUM.findall(lower(t or ""))
    out = set()
    for w in (w.encode() for w in words):
        out |= {("begins", w[:n]) for n in quality.BEGINNINGS if len(w) >= n} | ({("ends", w[-3:])} if len(w) >= 3 else set())
    return out | {("again",) for a, b in zip(words, words[1:]) if a == b}


def weights_by_force(texts, target):
    """log p_target / p_raw of each text by the models of the others, n-grams by themselves instead of buckets."""
    sets = [(i in target, i, grams_by_force(t)) for i, t in texts]
    every, inside = Counter(g for _, _, s in sets for g in s), Counter(g for good, _, s in sets if good for g in s)
    n, n_target, out = len(sets), sum(good for good, _, _ in sets), {}
    for good, i, own in sets:
        out[i] = 0.0
        for g in own:
            x = np.log((inside[g] - good + quality.PRIOR) / ((every[g] - 1) * (n_target - good) / (n - 1) + quality.PRIOR))
            out[i] += x if abs(x) >= np.log(quality.MARGIN) else 0.0
    return out


def vile_corpus():
    rng = np.random.default_rng(0)
    good, bad, text, labels = [f"word{'abcdefgh'[i % 8]}{i}" for i in range(60)], ["vile", "nasty", "awful"], [], []
    for i in range(240):
        w = list(rng.choice(good, 20))
        if i % 4 == 0:
            for j in rng.choice(20, 3, replace=False):
                w[j] = rng.choice(bad) + rng.choice(["er", "ing", "s"])
        text.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 1, int(i % 4 == 0)))
    return text, labels


def test_quality_weights_and_sample_equal_brute_force(spark):
    text, labels = vile_corpus()
    rows, table = [*text, (600, None), (601, "")], spark.createDataFrame([*labels, (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    want = weights_by_force(rows, {i for i, _, t in labels if not t})
    frame = docs(spark, rows).withColumn("log_weight", F.lit("mine")).withColumn("the_id", F.lit("x"))
    all_of_them = {r.doc_id: r.log_weight for r in quality.resample(frame, table, k=len(rows)).collect()}
    assert set(all_of_them) == set(want) and all(all_of_them[i] == pytest.approx(want[i], abs=1e-4) for i in want)
    gumbel = {r.doc_id: r.g for r in frame.select("doc_id", quality.noise(F.col("doc_id"), quality.SEED).alias("g")).collect()}
    for k in (1, 50, 200):
        top = sorted(want, key=lambda i: -(all_of_them[i] + gumbel[i]))[:k]
        assert {r.doc_id for r in quality.resample(frame, table, k=k).collect()} == set(top)
    known = [(want[i], not t) for i, _, t in labels]
    cut = quality.best_cut(np.array([w for w, _ in known]), np.array([g for _, g in known]))
    errors = lambda c: sum((w >= c) != g for w, g in known)
    assert errors(cut) == min(errors(c) for c, _ in known)
    kept = quality.resample(frame, table)
    assert kept.count() == sum(w >= cut - 1e-3 for w in want.values()) and kept.columns == [c for c in frame.columns if c != "log_weight"] + ["log_weight"]


def test_quality_keeps_clean_and_drops_bad_documents(spark):
    text, labels = vile_corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(docs(spark, [*text, (600, None)]), table).collect()}
    held = [i for i in range(240) if i % 3 == 0]
    assert sum(i in kept for i in held if i % 4) >= 0.95 * sum(i % 4 > 0 for i in held) and sum(i in kept for i in held if i % 4 == 0) <= 2 and 600 in kept
    repeated = docs(spark, [*text, text[1], text[1], (None, text[1][1]), (None, None)])
    assert quality.resample(repeated, table).where("doc_id is null").count() == 2  # ties and repeats don't crash, null ids are rows like others
    one_kind = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.resample(docs(spark, text), one_kind).count() == len(text)
    with pytest.raises(ValueError, match="integer"):
        quality.resample(spark.createDataFrame([("a", "b")], "doc_id string, text string"), table)


def test_threshold_takes_exactly_k(spark):
    keys = spark.createDataFrame([(float(x),) for x in np.random.default_rng(0).normal(size=5000)], "key double")
    for k in (1, 17, 2500, 5000):
        assert keys.where(F.col("key") >= quality._threshold(keys, k)).count() == k


def nearest_by_force(vectors, asked, k=5):
    """Of each asked id the k best (id, cosine)."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in asked:
        s = unit @ unit[ids.index(q)]
        out[q] = [(ids[j], s[j]) for j in sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(s[j], 12), ids[j]))[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[100]  # ties
    x[3], x[50] = x[3] * 1e200, x[50] * 1e-200  # squares beyond doubles
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    odd = df.unionAll(spark.createDataFrame([(850, [1.0] * 3), (851, [1.0] * 900), (852, [2.0, 1.0, 0.0])], df.schema))
    lists = []
    for table, questions in ((df, asked), (odd, odd.where("vec_id % 50 = 0"))):
        got = {}
        for r in ann.nearest(table, questions, pivots=64, prefix=24, shard=128, reranked=300).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        lists.append(got)
    got, with_odd = lists
    assert with_odd.pop(850) == [(852, pytest.approx(3 / np.sqrt(15)))] and with_odd == got  # odd vectors change nothing but themselves
    want = nearest_by_force(dict(enumerate(x)), range(0, 600, 50))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        exact = dict(want[q])
        hit += sum(v in exact for v, _ in found)
        assert len(found) == 5 and all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(found, found[1:]))
        assert all(s == pytest.approx(exact[v]) for v, s in found if v in exact)
    assert hit >= 0.9 * 5 * len(got) and [v for v, _ in got[100]] == [101, 102, 103, 104, 105]
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few).count() == 6


def test_neighbours_beside_many_copies(spark):
    """A third of all rows are one vector: the index still finds the others' neighbours."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = nearest_by_force(dict(enumerate(x)), range(50, 900, 50))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0 and vec_id > 0"), pivots=64, prefix=24, shard=256, reranked=250).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert sum(len({v for _, v in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_recall_on_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    want = nearest_by_force(vectors, [i for i in vectors if i % 50 == 0])
    got = {}
    for r in queries.op10_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) >= 0.97 * 5 * len(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_equal(spark, queries.QUERIES[name], queries.ORACLES[name])


STAGE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, log_weight string, n_removed string, spans string, the_id string"


def stage_table(spark, rows):
    """Documents with columns whose names stages and operators might use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *"abcd") for i, t in rows], STAGE_COLUMNS).repartition(3)


def tables_of_a_corpus(spark, folder, rows, labels, items):
    stage_table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def lines_by_force(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        parts, gone = t.split("\n") if t is not None else [], set()
        for p in range(len(parts) - 2):
            if first.setdefault(tuple(parts[p : p + 3]), (i, p)) != (i, p):
                gone.update((p, p + 1, p + 2))
        out[i] = None if t is None else "\n".join(x for p, x in enumerate(parts) if p not in gone)
    return sorted(out.items())


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    vile, labels = vile_corpus()
    extra = [(i + 1000, t) for i, t in corpus(3) if i < 60] + [(2000, None), (2001, ""), (2002, "p q\nr\ns t\nu"), (2003, "x\np q\nr\ns t\ny")]
    copy = " ".join(f"w{i}" for i in range(60))
    rows = [*vile, *extra, (3000, copy), (3001, f"{copy} more"), (3002, copy)]
    labels = [*labels, *((i, 1, 0) for i, t in extra[:60] if t and i % 3)]
    items = [(1, extra[1][1]), (2, "word nobody writes here at all so nothing matches it ever"), (3, None)]
    folder = tables_of_a_corpus(spark, str(tmp_path), rows, labels, items)
    kept = {}
    left = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, folder)
        assert left.schema.names == stage_table(spark, []).schema.names, name
        kept[name] = sorted(((r.doc_id, r.text) for r in left.collect()), key=lambda x: x[0])
    # quality: weights, cut, noise and the sample
    weight = weights_by_force(rows, {i for i, _, toxic in labels if not toxic})
    cut = quality.best_cut(np.array([weight[i] for i, _, _ in labels]), np.array([not x for _, _, x in labels]))
    frame = stage_table(spark, rows)
    gumbel = {r.doc_id: r.g for r in frame.select("doc_id", quality.noise(F.col("doc_id"), quality.SEED).alias("g")).collect()}
    best = sorted(rows, key=lambda x: -(weight[x[0]] + gumbel[x[0]]))[: sum(w >= cut - 1e-3 for w in weight.values())]
    assert kept["quality classifier"] == sorted(best)
    assert kept["line dedup"] == lines_by_force(kept["quality classifier"])
    root = components_by_force(kept["line dedup"], 5)
    assert kept["MinHash near-dedup"] == [(i, t) for i, t in kept["line dedup"] if root[i] == i]
    named = [(str(i), t) for i, t in items]
    clean = [(i, t) for i, t in kept["MinHash near-dedup"] if not overlaps_by_force(ALNUM.findall(lower(t or "")), named)[0]]
    assert kept["benchmark decontamination"] == clean and len(clean) < len(kept["MinHash near-dedup"]) < len(kept["line dedup"]) < len(rows)
    encode, pieces = tokens.encoder(queries.tokenizer_path()), {}
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == {i for i, _ in clean}
    for i, t in clean:
        ids = np.append(encode(t or ""), 1).astype("<u4")
        assert sorted(pieces[i]) == [(a, n, zlib.crc32(ids[a : a + n].tobytes())) for a, n, _ in sorted(pieces[i])] and sum(n for _, n, _ in pieces[i]) == len(ids)


def test_stages_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    odd = [(None, "a b"), (None, None), (1, None), (1, None), (2, ""), (3, "c d e f g h"), (3, "c d e f g h"), (4, "x " * 30_000)]
    for number, rows in enumerate(([], odd)):
        folder = tables_of_a_corpus(spark, str(tmp_path / str(number)), rows, [(2, 1, 0), (None, None, None), (99, 0, 1)], [(None, None)])
        left = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, folder)
            assert left.schema.names == stage_table(spark, []).schema.names
        assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(rows, key=str)
        assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == len({i for i, _ in rows})


def test_queries_of_neighbours_are_not_broadcast(spark):
    """What every shard is sent is the queries once a group of shards, which must not pass through the driver."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    found = ann.nearest(df, df.where("vec_id % 50 = 0"), shard=32)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 30


def test_pivots_are_those_of_the_smallest_hashes(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(3000)], "id long, vector array<double>")
    same = spark.createDataFrame([(7, [1.0, float(i), 0.0, 0.0]) for i in range(100)], "id long, vector array<double>")
    first = rows.orderBy(F.xxhash64("id"), "id").limit(32).select("vector").collect()
    unit = np.array([r.vector / np.sqrt((np.array(r.vector) ** 2).sum()) for r in first])
    assert np.allclose(ann.choose_pivots(rows, 8, 3000), unit[np.sort(np.unique(np.round(unit, 9), axis=0, return_index=True)[1])[:8]])
    assert len(ann.choose_pivots(same, 8, 100)) == 8
