"""The registered queries over the document tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, lines, minhash, mixing, oracles, packing, pii, quality, spelling, substrings, suffixes, token_counts, whitening

#: The key of the registered query only; a real one is a secret.
PII_KEY = "example"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=False)
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.drop_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.drop_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    n = F.size("entities").cast("long")
    return out.select("doc_id", n.alias("n_entities"), (n > 0).alias("changed"), "text")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every 199th run, by a checksum of it and its document, a letter is dropped: mistakes to find."""
    found = spelling.runs(table(spark, sf_dir, "documents"), id_col="doc_id", least=6)
    mark, size = F.crc32(F.concat_ws(":", F.col("doc").cast("string"), "word").cast("binary")), F.length("word")
    cut = F.concat(F.expr("left(word, cast(mark % size as int))"), F.expr("substring(word, cast(mark % size as int) + 2)"))
    words = found.withColumns({"mark": mark, "size": size}).select(F.when(F.col("mark") % 199 == 0, cut).otherwise(F.col("word")).alias("word"))
    return spelling.variants(spelling.counted(words, least_length=6, least_count=5), ratio=5)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.per_document(*mixing.mixed(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5))
    return out.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.by_component(whitening.whitened(table(spark, sf_dir, "embeddings"), most=16))
    return out.select(F.col("key").alias("vec_id"), F.col("component").cast("int").alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_pii": op9_pii,
    "op10_neighbours": op10_neighbours,
    "op11_spelling": op11_spelling,
    "op12_mixing": op12_mixing,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op2_decontamination": oracles.DECONTAMINATION,
    "op3_near_duplicates": oracles.NEAR_DUPLICATES,
    "op4_substring_dedup": oracles.PASSAGES,
    "op5_line_dedup": oracles.LINES,
    "op8_suffix_dedup": oracles.BYTES,
    "op9_pii": pii.oracle(PII_KEY),
    "op10_neighbours": oracles.NEIGHBOURS,
    "op11_spelling": oracles.SPELLING,
    "op12_mixing": oracles.MIXING,
}
