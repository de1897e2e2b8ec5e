"""Corpus preparation in stages: each takes (spark, docs, sf_dir) and returns what it keeps.

All but the last return the columns of ``docs``; extra columns are passed through, whatever their names. Each calls one operator of
lumenframe.llm with its defaults. Ids are integers. A stage decides on whole texts and all rows of its input:

* null and empty texts pass the first four stages (they have no n-grams, at most one line, no shingles and no words) and give one piece of
  one token in the last;
* rows with a null id are kept by all stages and take part in no comparison by id;
* rows that repeat an id are one document to line dedup and to near-dedup (if its id is kept, all its rows are), else rows like others;
* an empty table gives an empty one.

Near-duplicates here are documents with a Jaccard similarity of 0.8 or more of their five-word shingles, the default of the library; the
registered query op3 asks for two-word shingles, so it links more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.storage import Workspace, free_name
from lumenframe.llm import decontaminate, lines, minhash, packing, quality
from lumenframe.llm.queries import table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; toxic and low-quality ones go. All stay without labels of both kinds."""
    return quality.resample(docs, table(spark, sf_dir, "labels"), weight=free_name("log_weight", docs)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of windows of three that occurred before; n_chars follows the text."""
    total, removed = (free_name(n, docs) for n in lines.RESULTS)
    out = lines.drop_repeated_lines(docs, results=[total, removed])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return minhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words (or a whole shorter item) with a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences; a null text is an empty one."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Resampling, dynamic programming and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is saved before the next one reads it."""
    docs, work, last = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        saved = work.save(stage(spark, docs, sf_dir))
        work.drop(last)
        docs = last = saved
    return STAGES[-1][1](spark, docs, sf_dir)
