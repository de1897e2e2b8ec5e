"""Spelling variants of words: a symmetric-delete join that never makes pairs.

Every word emits itself and its single deletions, as keys. Words that share a key are near only if it says so where they were cut:

* the key is one word as it stands and a deletion of the other: they differ by an inserted code point;
* both lost the code point at the same place: they differ by a replaced one.

Two words with a common deletion that lost it at different places are at distance two. So a shared key is verified exactly by comparing
places, and what a word needs of its fellows - how many are near, and the most frequent of them - are counts and maxima over a key and a place.
No pair of words is made, however many share a key: the work grows with the letters of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import Workspace, map_arrow

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points whose keys are made, and keys that are sent, at once.
SLICE = 1 << 20
#: The place of a word that stands as it is.
WHOLE = -1


def runs(df: DataFrame, text_col: str = "text", id_col: str | None = None, least: int = 1) -> DataFrame:
    """(doc, word): a row for each maximal run of at least ``least`` letters of each whole text, A-Z as a-z. doc is null without ``id_col``.

    Null and empty texts give no rows."""
    doc = df[id_col] if id_col else F.lit(None)
    found = F.regexp_extract_all(df[text_col].cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return df.select(doc.alias("doc"), F.explode(found).alias("word")).withColumn("word", F.translate("word", UPPER, LOWER))


def counted(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): how often each word of ``words`` occurs, of those long and frequent enough. Counted before anything is shuffled."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that look random, of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(code: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole words and, for each place, of the word without it.

    A string's hash is the sum of random numbers of its code points with their places. A deletion moves what follows by one place, so its
    hash is a prefix sum and a suffix sum, and all deletions of a word cost no more than its length."""
    salt = np.uint64(seed) * np.uint64(40503)
    code = _mixed(code.astype(np.uint64) + salt)
    sums = lambda p: np.append(np.uint64(0), np.cumsum(_mixed(code + p.astype(np.uint64)), dtype=np.uint64))
    stay, moved, at = sums(place), sums(place - 1), np.arange(len(code))
    return stay[end] - stay[start], stay[at] - stay[start][of] + moved[end][of] - moved[at + 1]


def keys(words: DataFrame) -> DataFrame:
    """(rank, n, a, b, place, once) of (rank, word, n): for each word a row of itself (place -1), and a row for each place with the word
    without it. a and b are 128 bits of hash of what is left. ``once`` marks one row of those that leave the same, as in a run of one letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rank", "n", "a", "b", "place", "once"]
        for batch in batches:
            width = pc.utf8_length(batch.column("word")).to_numpy().astype(np.int64)
            cut = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(width) // SLICE)) + 1, [len(batch)]]))
            for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                part, size = batch.slice(low, high - low), width[low:high]
                code = np.frombuffer("".join(part.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
                end = np.cumsum(size)
                start = end - size
                of = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(code)) - start[of]
                (whole_a, cut_a), (whole_b, cut_b) = (_sums(code, place, start, end, of, seed) for seed in (11, 4242))
                once = np.append(True, code[1:] != code[:-1]) | (place == 0)
                rank, n = part.column("rank").to_numpy(), part.column("n").to_numpy()
                columns = [
                    np.concatenate([rank, rank[of]]), np.concatenate([n, n[of]]),
                    np.concatenate([whole_a, cut_a]).view(np.int64), np.concatenate([whole_b, cut_b]).view(np.int64),
                    np.concatenate([np.full(len(size), WHOLE), place]), np.concatenate([np.zeros(len(size), bool), once]),
                ]
                for i in range(0, len(columns[0]), SLICE):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + SLICE]) for c in columns], names)

    return map_arrow(words.select("rank", "word", "n"), run, "rank long, n long, a long, b long, place long, once boolean")


def near_counts(keyed: DataFrame) -> DataFrame:
    """(rank, n_near, best) of ``keys``' rows, for words with near words: how many, and (n, -rank) of the most frequent, of equals the first.

    A key's rows lie together, but only those at one place are near each other, and there are as many of these as there are letters."""
    frequent = F.struct(F.col("n"), (-F.col("rank")).alias("r"))
    down = Window.partitionBy("a", "b", "place").orderBy(F.desc("n"), "rank")
    keyed = keyed.repartition("a", "b")  # serves both windows
    rows = keyed.select("*", frequent.alias("me"), F.row_number().over(down).alias("i"), F.first(frequent).over(down).alias("first"), F.lead(frequent).over(down).alias("second"))
    at_place, at_key = Window.partitionBy("a", "b", "place"), Window.partitionBy("a", "b")
    rows = rows.withColumn("replaced", F.count("*").over(at_place) - 1)
    rows = rows.select(
        "rank", "place", "once", "replaced",
        F.when(F.col("i") == 1, F.col("second")).otherwise(F.col("first")).alias("best_replaced"),
        F.max(F.when(F.col("place") == WHOLE, F.col("me"))).over(at_key).alias("itself"),
        F.count(F.when(F.col("once"), 1)).over(at_key).alias("longer"),
        F.max(F.when(F.col("once"), F.col("me"))).over(at_key).alias("best_longer"),
    )
    shorter = F.when(F.col("once"), F.col("itself"))
    whole = F.col("place") == WHOLE
    found = rows.select(
        "rank",
        F.when(whole, F.col("longer")).otherwise(F.col("replaced") + shorter.isNotNull().cast("long")).alias("near"),
        F.when(whole, F.col("best_longer")).otherwise(F.greatest("best_replaced", shorter)).alias("best"),
    )
    return found.where("near > 0").groupBy("rank").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """(rank, to) of (rank, to): the last word of each chain of forms. Chains double in length a round, and a form is ``ratio`` times as
    frequent as its word, so there are few rounds."""
    now = work.save(forms)
    while True:
        further = now.select(F.col("rank").alias("to"), F.col("to").alias("next"))
        new = work.save(now.join(further, "to", "left").select("rank", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        work.drop(now)
        if new.where("moved").isEmpty():
            return new.select("rank", "to")
        now = work.save(new.select("rank", "to"))
        work.drop(new)


def variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of ``counts`` (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is the most frequent near word,
    of equals the first in code-point order, if it is at least ``ratio`` times as frequent; root follows forms to the last. Without such a
    form, form and form_n are null and root is the word. ratio is at least 2, so that chains end.

    Null words and counts are left out; rows that repeat a word are one word with their counts added; the empty word is near all words of one code
    point; an empty table gives no rows; other columns are not read. Words are numbered in code-point order, and only numbers are shuffled
    from then on; keys are compared by 128 bits of hash."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    work = Workspace(counts.sparkSession, "spelling")
    given = counts.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).dropna().groupBy("word").agg(F.sum("n").alias("n"))
    words = work.save(given.orderBy("word").select(F.monotonically_increasing_id().alias("rank"), "word", "n"))
    near = near_counts(keys(words))
    near = near.select("rank", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.r")).alias("best_rank"))
    enough = F.col("best_n") >= ratio * F.col("n")
    rows = words.join(near, "rank", "left").select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best_rank")).alias("to"), F.when(enough, F.col("best_n")).alias("form_n")
    )
    rows = work.save(rows)
    roots = _roots(rows.where("to is not null").select("rank", "to"), work)
    changed = rows.where("to is not null").join(roots.toDF("rank", "root_rank"), "rank")
    changed = changed.join(words.select(F.col("rank").alias("to"), F.col("word").alias("form")), "to")
    changed = changed.join(words.select(F.col("rank").alias("root_rank"), F.col("word").alias("root")), "root_rank")
    same = rows.where("to is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return changed.select(same.columns).unionAll(same)
