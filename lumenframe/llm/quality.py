"""Quality classifier by importance resampling.

Two generative models over hashed n-grams - of the target (documents labelled good and not toxic) and of the raw text (all documents) -
say for each n-gram in what share of documents it occurs. A document's log importance weight is the sum of log p_target / p_raw over
the n-grams that it has, of either sign, and documents are sampled without replacement by Gumbel top-k: the k largest of weight plus
Gumbel noise.

* The n-grams are those of bytes at the beginnings and ends of words, and the bigram of a word with itself, whichever word.
* A document is scored by the models of all other documents (its own counts are taken out), so having been labelled is no
  advantage.
* Shares are smoothed by ``PRIOR`` expected documents, and a ratio within a factor of ``MARGIN`` of 1 counts as 1: the raw text contains
  the target with some share s, so a ratio can't exceed 1 / s, and the sum of hundreds of such small advantages would grow with a
  text's length and drown what matters.
* k, unless given, is the number of documents in the corpus whose weight reaches the cut that tells labelled documents apart with the
  fewest errors; it grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .work import Workspace, free_name, integer_id, map_arrow, without

BITS = 20
BUCKETS = 1 << BITS
#: The n-grams of bytes: so many from a word's beginning, and so many at its end.
BEGINNINGS = (3, 4, 5, 6)
ENDING = 3
#: Most labelled rows that the target model is fitted on; they are broadcast, 9 bytes each.
MAX_LABELS = 200_000
PRIOR = 5.0
MARGIN = 2.0
SEED = 17
_PARTS = 64
_BINS = 4096
#: The column that a sampled row has besides its own.
WEIGHT = "log_weight"


def _bucket(keys: np.ndarray, kind: int) -> np.ndarray:
    return (kernels.mix(keys + np.uint64(kind * 0x9E3779B97F4A7C1)) >> np.uint64(64 - BITS)).astype(np.int64)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct n-grams of each text, as text * BUCKETS + bucket, ascending. Words are what ASCII punctuation, white space and
    digits don't break, with A-Z in lower case."""
    lower = kernels.LOWER[data]
    starts, ends, text = kernels.spans(lower, offsets, kernels.ALNUM)
    first, last = kernels.head_bytes(lower, starts), kernels.head_bytes(lower, np.maximum(ends - ENDING, 0))
    parts = []
    for size in BEGINNINGS:
        long = ends - starts >= size
        parts.append(text[long] * BUCKETS + _bucket(first[long] & kernels.low_bytes(size), size))
    long = ends - starts >= ENDING
    parts.append(text[long] * BUCKETS + _bucket(last[long] & kernels.low_bytes(ENDING), 10 + ENDING))
    words = kernels.span_hash(lower, starts, ends)
    again = np.unique(text[1:][(words[1:] == words[:-1]) & (text[1:] == text[:-1])])
    parts.append(again * BUCKETS + _bucket(np.zeros(1, np.uint64), 20))
    return np.unique(np.concatenate(parts))


def _label_sample(labels: DataFrame, id_col: str, good: F.Column, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and goodness of at most ``limit`` labelled documents, those of the smallest hashed ids; an id with both is bad."""
    rows = labels.select(labels[id_col].cast("long").alias("id"), good.cast("boolean").alias("good")).dropna()
    rows = rows.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(limit).toArrow()
    ids, flags = rows.column("id").to_numpy(), rows.column("good").to_numpy()
    order = np.argsort(ids)
    return ids[order], flags[order].astype(bool)


def _in_target(column: pa.Array, ids: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Which rows' ids are those of the target."""
    own, valid = column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    if not len(ids):
        return np.zeros(len(own), bool)
    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    return (ids[at] == own) & valid & good[at]


def gram_counts(docs: DataFrame, ids: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents each bucket occurs: rows target and all; and how many documents each row counts.

    Every task adds up its documents before it sends anything, so what is shuffled is a table of buckets for each task."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, good))
    step = BUCKETS // _PARTS
    schema = "part int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros((2, BUCKETS), np.int64), np.zeros((2, 1), np.int64)
        for batch in batches:
            for low, high, data, offsets in kernels.text_slices(batch):
                target = _in_target(batch.column("id").slice(low, high - low), *shared.value)
                total[:, 0] += [target.sum(), len(target)]
                pairs = grams(data, offsets)
                text, bucket = pairs >> BITS, pairs & (BUCKETS - 1)
                counts[0] += np.bincount(bucket[target[text]], minlength=BUCKETS)
                counts[1] += np.bincount(bucket, minlength=BUCKETS)
        parts = [np.ascontiguousarray(counts[:, i * step : (i + 1) * step]).tobytes() for i in range(_PARTS)] + [total.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS + 1), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in group:
            for blob in batch.column("counts"):
                values = np.frombuffer(blob.as_buffer(), np.int64)
                total = values.copy() if total is None else total + values
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    rows = map_arrow(docs, run, schema).groupBy("part").applyInArrow(add, schema).collect()
    found = {r["part"]: np.frombuffer(r["counts"], np.int64).reshape(2, -1) for r in rows}
    if not found:
        return np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    return np.concatenate([found[i] for i in range(_PARTS)], axis=1), found[_PARTS][:, 0]


def log_ratios(counts: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log p_target / p_raw of each bucket for a document outside the target, and for one inside, without the document itself."""
    target, every = counts.astype(float)
    n_target, n = total.astype(float)

    def ratio(inside: float) -> np.ndarray:
        expected = np.maximum(every - 1, 0) * max(n_target - inside, 0) / max(n - 1, 1)
        out = np.log((np.maximum(target - inside, 0) + PRIOR) / (expected + PRIOR))
        return np.where(np.abs(out) < np.log(MARGIN), 0, out).astype(np.float32)

    return ratio(0.0), ratio(1.0)


def log_weights(df: DataFrame, id_name: str, text_name: str, names: list[str], weight: str, ratios: tuple[np.ndarray, np.ndarray], ids: np.ndarray, good: np.ndarray) -> DataFrame:
    """The columns ``names`` of ``df`` and ``weight``."""
    shared = df.sparkSession.sparkContext.broadcast((ratios, ids, good))
    schema = T.StructType([*(df.schema[n] for n in names), T.StructField(weight, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (outside, inside), known, flag = shared.value
        for batch in batches:
            out = np.zeros(len(batch))
            for low, high, data, offsets in kernels.text_slices(batch, text_name):
                target = _in_target(batch.column(id_name).slice(low, high - low), known, flag)
                pairs = grams(data, offsets)
                text, bucket = pairs >> BITS, pairs & (BUCKETS - 1)
                out[low:high] = np.bincount(text, weights=np.where(target[text], inside[bucket], outside[bucket]), minlength=high - low)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out)], schema.names)

    return map_arrow(df, run, schema)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight such that taking all from it on as good makes the fewest errors; of equals the smallest."""
    order = np.argsort(-weights, kind="stable")
    weights, good = weights[order], good[order]
    errors = np.cumsum(~good) + good.sum() - np.cumsum(good)
    last = np.append(weights[1:] != weights[:-1], True)  # equal weights go together
    errors = np.where(last, errors, len(weights) + 1)
    return float(weights[len(errors) - 1 - errors[::-1].argmin()])


def _threshold(keys: DataFrame, k: int) -> float:
    """A value such that ``k`` rows of ``keys`` (key) are at least as large, or more by ties: by counting in ever finer bins."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0  # rows over ``high``
    while high > low:
        width = (high - low) / _BINS
        if width <= 0 or low + width == low:
            break
        bins = F.least(F.floor((F.col("key") - low) / width), F.lit(_BINS - 1)).alias("bin")
        rows = keys.where(F.col("key").between(low, high)).groupBy(bins).agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).orderBy(F.desc("bin")).collect()
        for row in rows:
            if above + row["n"] >= k:
                break
            above += row["n"]
        low, high = row["least"], row["most"]
        if above + row["n"] == k:
            return low
    return low


def noise(column: F.Column, seed: int) -> F.Column:
    """Gumbel noise of an id."""
    uniform = (F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def resample(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    good: F.Column | None = None,
    k: int | None = None,
    max_labels: int = MAX_LABELS,
    seed: int = SEED,
    keep: list[str] | None = None,
    weight: str = WEIGHT,
) -> DataFrame:
    """The rows of ``df`` that are sampled, with their columns (those in ``keep``) and log_weight.

    good: which labels mean the target; by default quality 1 and toxic 0. Labels without an id or with a null in these are left out; an
    id with both counts as not good. k: how many rows to sample; more come by ties only. Null and empty texts have no n-grams and weight
    0; rows with a null id are sampled like others (all null ids draw the same noise, as do rows that repeat an id); without labels of
    both kinds and without k every row is kept, with weight 0; an empty table gives no rows. Ids are integers. A column named
    log_weight (or ``weight``) gives way to the result's.
    """
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)) if good is None else good
    work = Workspace(df.sparkSession, "quality")
    source = without(df if keep is None else df.select(*keep), [weight])
    names, id_name, text_name = source.columns, free_name("the_id", df), free_name("the_text", df)
    rows = df.withColumns({id_name: integer_id(df, id_col), text_name: df[text_col].cast("string")}).select(*names, id_name, text_name)
    ids, flags = _label_sample(labels, id_col, good, max_labels)
    if k is None and (flags.all() or not flags.any()):
        return source.withColumn(weight, F.lit(0.0))
    ratios = log_ratios(*gram_counts(rows.select(F.col(id_name).alias("id"), F.col(text_name).alias("text")), ids, flags))
    weighed = work.save(log_weights(rows, id_name, text_name, [*names, id_name], weight, ratios, ids, flags))
    if k is None:
        known = df.sparkSession.createDataFrame(pa.table({"i": ids, "g": flags}))
        of_labels = weighed.select(F.col(id_name).alias("i"), weight).join(F.broadcast(known), "i").groupBy("i", "g").agg(F.min(weight).alias("w")).toArrow()
        if not len(of_labels):
            return weighed.drop(id_name)
        cut = best_cut(of_labels.column("w").to_numpy(), of_labels.column("g").to_numpy(zero_copy_only=False).astype(bool))
        k = weighed.where(F.col(weight) >= cut).count()
    key = F.col(weight) + noise(F.col(id_name), seed)
    least = _threshold(weighed.select(key.alias("key")), max(1, k))
    return weighed.where(key >= (F.lit(float("inf")) if least is None else F.lit(least))).drop(id_name)
