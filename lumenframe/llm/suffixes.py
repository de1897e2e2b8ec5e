"""Removal of byte strings that occur anywhere else too, by suffix arrays.

Shards of repeated text are made as in ``repeats``; a shard's distinct segments make one string, whose suffix array is built by
induced sorting and whose common prefixes are computed in text order. Neighbours in the array that share at least a
window's length make up the occurrences of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels, repeats, sais
from .work import Workspace, free_name, map_arrow, wide_key, without

WINDOW = 200
GRAM = 40
RESULTS = ["n_bytes", "n_removed", "n_spans", "kept", "spans"]


def occurrences(length: int) -> repeats.Indexer:
    """Of each window 1 if it occurs more than once, else 0."""

    def index(data: np.ndarray, bounds: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        text, owner, window = repeats.joined_segments(data, bounds, length)
        array = sais.suffix_array(text)
        prefix = sais.permuted_lcp(text, array)
        group = np.empty(len(text), np.int64)
        group[array] = np.cumsum(prefix[array] < length)
        times = np.bincount(group[window], weights=n[owner[window]])
        return (times[group[window]] > 1).astype(np.int64)

    return index


def drop_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW, gram: int = GRAM, split: int | None = None) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans, kept and spans: how many UTF-8 bytes a text has and how many of them go, in how many
    maximal runs, the others, as binary (a run may begin or end inside a character), and the runs (start, length).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text included; strings are judged on the
    input and never span texts. Null and empty texts have no bytes; texts shorter than ``length`` keep all. Rows are told apart by 128 bits of
    hash of id and text, so a null id or a repeated one is no matter; repeated rows repeat each other's strings and lose them all. An
    empty table gives no rows. Other columns are passed through; one with a result's name gives way to it.
    """
    work = Workspace(df.sparkSession, "suffixes")
    text = df[text_col].cast("string")
    key = wide_key(df[id_col], text)
    docs = df.select(key.alias("key"), text.alias("text"))
    scheme = repeats.Scheme(words=False, length=length, gram=gram)
    twice = lambda low, n: (n > 1).cast("long")
    found = repeats.repeated_windows(docs, scheme, occurrences(length), twice, lambda v, key: v > 0, work, split)
    text_name, found_name, key_name = (free_name(n, df) for n in ("the_text", "the_found", "the_key"))
    rows = df.withColumns({text_name: text, key_name: key}).join(found.toDF(key_name, found_name), key_name, "left")
    kept = without(df, RESULTS)
    long = T.LongType()
    extra = [T.StructField("n_bytes", long), T.StructField("n_removed", long), T.StructField("n_spans", long), T.StructField("kept", T.BinaryType()), T.StructField("spans", repeats.SPANS)]
    schema = T.StructType([*kept.schema.fields, *extra])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernels.text_slices(batch, text_name):
                sizes = np.diff(offsets)
                hit, first = repeats.hit_symbols(batch.column(found_name).slice(low, high - low), sizes, length)
                owner = np.repeat(np.arange(high - low), sizes)
                removed, spans = np.bincount(owner[hit], minlength=high - low), repeats.spans_of(hit, owner, first)
                bound = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
                left = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(bound), pa.py_buffer(data[~hit])])
                columns = [batch.column(c).slice(low, high - low) for c in names]
                count = spans.value_lengths().cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), pa.array(removed), count, left, spans], schema.names)

    return map_arrow(rows.select(*names, text_name, found_name), run, schema)
