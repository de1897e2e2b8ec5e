"""Line deduplication over overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .work import Workspace, free_name, integer_id, join_by_size, map_arrow, without

WIDTH = 3
LINE_FEED = 0x0A


def line_spans(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of lines; an empty text is one empty line, an invalid one has none."""
    feeds = np.flatnonzero(data == LINE_FEED)
    counts = np.where(valid, np.bincount(np.searchsorted(offsets, feeds, "right") - 1, minlength=len(valid)) + 1, 0)
    text = np.repeat(np.arange(len(valid)), counts)
    first = np.zeros(len(text), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    last = np.zeros(len(text), bool)
    last[(np.cumsum(counts) - 1)[counts > 0]] = True
    starts, ends = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    starts[first], starts[~first] = offsets[:-1][valid], feeds + 1
    ends[last], ends[~last] = offsets[1:][valid], feeds
    return starts, ends, text


def _windows(df: DataFrame, width: int) -> DataFrame:
    """(id, pos, h, g) of every window of every row of (id, text): its first line's number and 128 bits of hash."""
    long = T.LongType()
    names = ["id", "pos", "h", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernels.text_slices(batch):
                valid = batch.column("text").slice(low, high - low).is_valid().to_numpy(zero_copy_only=False)
                starts, ends, text = line_spans(data, offsets, valid)
                lines = kernels.span_hash(data, starts, ends)
                n = len(lines) - width + 1
                if n <= 0:
                    continue
                at = np.flatnonzero(text[:n] == text[width - 1 :])
                counts = np.bincount(text, minlength=high - low)
                pos = at - (np.cumsum(counts) - counts)[text[at]]
                h, g = kernels.gram_hash(lines, width)[at], kernels.gram_hash(kernels.mix(lines ^ np.uint64(WIDTH)), width)[at]
                ids = batch.column("id").slice(low, high - low).take(pa.array(text[at]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(pos), pa.array(kernels.signed(h)), pa.array(kernels.signed(g))], names)

    return map_arrow(df, run, T.StructType([T.StructField(n, long) for n in names]))


RESULTS = ["n_lines", "n_removed"]


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, results: list[str] | None = None) -> DataFrame:
    """``df`` with the lines of repeated windows taken out of ``text_col``, and n_lines and n_removed (or the names in ``results``): how many.

    A window is ``width`` consecutive lines of a text, compared as they are (by 128 bits of hash). Of equal windows the first by (id, line
    number) stays; every line that a later one covers goes, in all texts, judged on the input. Line feeds separate lines, so an
    empty text is one empty line; null stays null and has no lines. Texts of fewer lines than ``width`` and rows with
    a null id stay as they are; rows that repeat an id are one document and lose the same lines. Ids are integers. An empty table
    gives no rows. Other columns are passed through; one with a result's name gives way to it.
    """
    work = Workspace(df.sparkSession, "lines")
    ids, results = integer_id(df, id_col), results or RESULTS
    windows = work.save(_windows(df.select(ids.alias("id"), df[text_col].cast("string").alias("text")).where("id is not null"), width))
    firsts = work.save(windows.groupBy("h", "g").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1"))
    repeated = work.save(join_by_size(windows, firsts, ["h", "g"], "n", windows.count()))
    work.drop(windows, firsts)
    place = work.save(repeated.where("id = low").groupBy("h", "g").agg(F.min("pos").alias("at"), F.first("n").alias("n")))
    later = join_by_size(repeated.drop("n"), place, ["h", "g"], "n", repeated.count()).where("id > low or pos > at")
    gone = later.groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    text_name, gone_name, key_name = (free_name(n, df) for n in ("the_text", "the_gone", "the_key"))
    joined = df.withColumn(text_name, df[text_col].cast("string")).join(gone.toDF(key_name, gone_name), ids == F.col(key_name), "left").drop(key_name)
    return _rebuild(joined, without(df, results), text_col, text_name, gone_name, width, results)


def _rebuild(joined: DataFrame, kept: DataFrame, text_col: str, text_name: str, gone_name: str, width: int, results: list[str]) -> DataFrame:
    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in kept.schema.fields]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType(), False) for n in results)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in kernels.text_slices(batch, text_name):
                part = batch.slice(low, high - low)
                texts, gone = part.column(text_name), part.column(gone_name)
                valid = texts.is_valid().to_numpy(zero_copy_only=False)
                feeds = np.bincount(np.searchsorted(offsets, np.flatnonzero(data == LINE_FEED), "right") - 1, minlength=len(valid))
                lines = np.where(valid, feeds + 1, 0)
                removed = np.zeros(len(valid), np.int64)
                some = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False) & valid)
                if len(some):
                    new = texts.to_pylist()
                    for i in some.tolist():
                        at = np.array(gone[i].as_py())
                        hit = kernels.cover(int(lines[i]), at[at < lines[i]], width)
                        removed[i] = int(hit.sum())
                        new[i] = "\n".join(line for line, drop in zip(new[i].split("\n"), hit, strict=True) if not drop)
                    texts = pa.array(new, pa.string())
                columns = [texts if f.name == text_col else part.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines.astype(np.int64)), pa.array(removed)], schema.names)

    return map_arrow(joined.select(*[c for c in kept.columns if c != text_col], text_name, gone_name), run, schema)
