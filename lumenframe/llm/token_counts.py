"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .work import Workspace, map_arrow

#: Lengths in a block of the two-level suffix sums.
BLOCK = 256


def encoded_lengths(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``length``, the number of ids of its text (null text: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        for batch in batches:
            lengths = (len(encode(text.as_py())) if text.is_valid else 0 for text in batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(lengths, np.int64, len(batch)))], ["length"])

    only = df.select(df[text_col].cast("string").alias("text"))
    return map_arrow(only, run, T.StructType([T.StructField("length", T.LongType(), False)]))


def length_table(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """One row per distinct encoded length L, taken as a context limit.

    length; n_docs, n_tokens: documents of exactly L ids and their ids; docs_at_least, tokens_at_least: suffix
    sums over lengths >= L; docs_longer: documents that a limit of L cuts; total_docs, total_tokens;
    truncated_total: ids left if every document is cut at L; lost: ids cut off; quantile: the share of documents
    of at most L ids, so a quantile q is the least length whose value reaches q.

    Null and empty texts have length 0; repeated rows count each time; an empty table gives no rows; other columns
    are not read. Only the histogram - as many rows as distinct lengths - leaves the map side, and its suffix
    sums run over blocks of lengths, so no task sorts all of it.
    """
    histogram = encoded_lengths(df, tokenizer, text_col).groupBy("length").agg(F.count("*").alias("n_docs"))
    histogram = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"))
    return suffix_table(Workspace(df.sparkSession, "lengths").save(histogram))  # read twice, encoded once


def suffix_table(histogram: DataFrame) -> DataFrame:
    """length_table's columns from a histogram (length, n_docs, n_tokens)."""
    block = F.floor(F.col("length") / BLOCK).alias("block")
    rows = histogram.select(block, "length", "n_docs", "n_tokens")
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(whole).alias("total_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    down = Window.partitionBy("block").orderBy(F.desc("length"))
    rows = rows.join(blocks, "block").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.col("docs_above") + F.sum("n_docs").over(down)).alias("docs_at_least"),
        (F.col("tokens_above") + F.sum("n_tokens").over(down)).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    longer = F.col("docs_at_least") - F.col("n_docs")
    cut = F.col("tokens_at_least") - F.col("length") * F.col("docs_at_least")
    return rows.select(
        *rows.columns,
        longer.alias("docs_longer"),
        (F.col("total_tokens") - cut).alias("truncated_total"),
        cut.alias("lost"),
        ((F.col("total_docs") - longer) / F.col("total_docs")).alias("quantile"),
    )


def for_limits(table: DataFrame, limits: DataFrame, name: str = "limit") -> DataFrame:
    """What ``length_table`` answers for any context limits, somebody's length or not: one row per row of ``limits``.

    limit; n_docs of exactly that length; docs_longer that the limit cuts; total_docs, total_tokens; truncated_total: ids left if every
    document is cut there; lost; quantile: the share of documents of at most so many ids.

    Beside its own length a limit L needs the suffix sums of the least length above it: documents and ids longer than L. Both are looked up in the limit's
    block of lengths; only the row of each block, for the next one that isn't empty, is ordered in one task. A null or negative limit has null answers, repeated limits a row each; with no documents the
    totals are 0 and quantile is null. Other columns of ``limits`` are not kept."""
    at = F.when(F.col(name) >= 0, F.col(name).cast("long"))
    asked = limits.select(at.alias("limit"), F.col(name).alias("given"))
    block = F.floor(F.col("length") / BLOCK)
    rows = table.select(block.alias("block"), "length", "docs_at_least", "tokens_at_least", F.col("n_docs").alias("exact"))
    firsts = rows.groupBy("block").agg(F.min(F.struct("length", "docs_at_least", "tokens_at_least")).alias("f"))
    blocks = firsts.select("block", F.col("f.docs_at_least").alias("docs"), F.col("f.tokens_at_least").alias("ids"))
    wanted = asked.where("limit is not null").select("limit").distinct().withColumn("block", F.floor(F.col("limit") / BLOCK))
    # within the limit's own block
    inside = wanted.join(rows, "block").groupBy("limit").agg(
        F.min(F.when(F.col("length") > F.col("limit"), F.struct("length", "docs_at_least", "tokens_at_least"))).alias("next"),
        F.max(F.when(F.col("length") == F.col("limit"), F.col("exact"))).alias("exact"),
    )
    # else the first length of the next block that has one: a row for each block of lengths or limits, in one order
    both = blocks.join(wanted.select("block").distinct(), "block", "full")
    after = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    later = both.select("block", F.first(F.when(F.col("docs").isNotNull(), F.struct("docs", "ids")), ignorenulls=True).over(after).alias("far"))
    totals = table.agg(F.coalesce(F.max("total_docs"), F.lit(0)).alias("total_docs"), F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"))
    found = wanted.join(later, "block").join(inside, "limit", "left").join(F.broadcast(totals))  # one row
    longer = F.coalesce(F.col("next.docs_at_least"), F.col("far.docs"), F.lit(0))
    lost = F.coalesce(F.col("next.tokens_at_least"), F.col("far.ids"), F.lit(0)) - F.col("limit") * longer
    answers = found.select(
        "limit",
        F.coalesce("exact", F.lit(0)).alias("n_docs"),
        longer.alias("docs_longer"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - lost).alias("truncated_total"),
        lost.alias("lost"),
        F.when(F.col("total_docs") > 0, (F.col("total_docs") - longer) / F.col("total_docs")).alias("quantile"),
    )
    out = asked.join(answers, "limit", "left")
    return out.select(F.col("given").cast("long").alias("limit"), *[c for c in answers.columns if c != "limit"])
