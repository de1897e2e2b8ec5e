"""Removal of word passages that an earlier document has too, by compressed FM-indexes.

Shards of repeated text are made as in ``repeats``: all segments that can hold an occurrence of a window are in one shard. A shard's distinct
segments, over an exact dictionary of its words, make one FM-index (the transform in a wavelet matrix, sampled places); the documents'
segments are streamed through it backwards, word by word. Of the matching statistics only one thing is asked: whether a match
into a smaller document reaches ``length`` words. So a pattern is followed over ``length`` words; its interval holds all its
occurrences, and the smallest document among them, located through the transform, tells who may keep it. What is reported are
the maximal intervals of words in such matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels, repeats
from .fm_index import FmIndex
from .work import Workspace, free_name, integer_id, map_arrow, without

WINDOW = 13
GRAM = 5


def dictionary(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A number from 1 on for each word, equal for equal bytes only."""
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1


def smallest_documents(scheme: repeats.Scheme) -> repeats.Indexer:
    """Of each window the smallest document that has it."""

    def index(data: np.ndarray, bounds: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        begins = scheme.begins(data, bounds)
        symbols, first = dictionary(data, begins), np.searchsorted(begins, bounds)
        windows = np.diff(first) - scheme.length + 1
        window, owner = np.repeat(first[:-1], windows) + kernels.ranges(windows), np.repeat(np.arange(len(low)), windows)
        fm = FmIndex(symbols, first)
        begin, end = fm.search(symbols[window + j] for j in range(scheme.length - 1, -1, -1))
        least = low[owner].copy()  # right for windows of one segment only
        shared = np.flatnonzero(end - begin > 1)
        if len(shared):
            interval, which = np.unique(begin[shared], return_index=True)
            size = (end - begin)[shared][which]
            rows = np.repeat(interval, size) + kernels.ranges(size)
            smallest = np.minimum.reduceat(low[fm.locate(rows)], np.cumsum(size) - size)
            least[shared] = smallest[np.searchsorted(interval, begin[shared])]
        return least

    return index


RESULTS = ["n_words", "n_removed", "kept", "spans"]


def drop_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW, gram: int = GRAM, split: int | None = None) -> DataFrame:
    """``df`` with n_words, n_removed, kept and spans: how many words a text has, how many of them go, the others joined by one space, and
    the maximal runs (start, length) of words that go.

    A word goes if a window of ``length`` consecutive words that covers it also starts in a document with a smaller id; windows are
    judged on the input. Words are what ASCII white space separates, as they are, and compared byte by byte. Null and empty texts have
    no words and keep ''; texts of fewer words than ``length`` keep all, and so do rows with a null id, which also take nothing from
    others. Rows that share an id don't take from each other but lose the same words. An empty table gives no rows. Ids are
    integers. Other columns are passed through; one with a result's name gives way to it.
    """
    work = Workspace(df.sparkSession, "substrings")
    ids = integer_id(df, id_col)
    docs = df.select(ids.alias("key"), df[text_col].cast("string").alias("text")).where("key is not null")
    scheme = repeats.Scheme(words=True, length=length, gram=gram)
    found = repeats.repeated_windows(docs, scheme, smallest_documents(scheme), lambda low, n: low, lambda v, key: v < key, work, split)
    text_name, found_name, key_name = (free_name(n, df) for n in ("the_text", "the_found", "the_key"))
    rows = df.withColumn(text_name, df[text_col].cast("string")).join(found.toDF(key_name, found_name), ids == F.col(key_name), "left").drop(key_name)
    kept = without(df, RESULTS)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("spans", repeats.SPANS)])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernels.text_slices(batch, text_name):
                starts, ends, text = kernels.spans(data, offsets, kernels.NON_SPACE)
                words = np.bincount(text, minlength=high - low)
                hit, first = repeats.hit_symbols(batch.column(found_name).slice(low, high - low), words, length)
                removed = np.bincount(text[hit], minlength=high - low)
                left = join_spans(data, starts[~hit], ends[~hit], text[~hit], high - low)
                columns = [batch.column(c).slice(low, high - low) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words), pa.array(removed), left, repeats.spans_of(hit, text, first)], schema.names)

    return map_arrow(rows.select(*names, text_name, found_name), run, schema)


def join_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> pa.Array:
    """The spans of each of ``n`` texts joined by one space."""
    out, begins = kernels.joined(data, starts, ends)
    bound = begins[np.searchsorted(text, np.arange(n + 1))]
    some = np.diff(bound) > 0
    keep = np.ones(len(out), bool)
    keep[bound[1:][some] - 1] = False  # the last span's space
    offsets = np.concatenate([[0], np.cumsum(np.diff(bound) - some)]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out[keep]))
