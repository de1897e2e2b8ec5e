"""Sinks: Parquet, CSV, per-group files, JSON, and stages that are written once."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def report_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder with one file with a header: for reports, which are small. ``append`` adds another file, with its own header as each file of a
    CSV folder has one; readers of the folder see one table."""
    df.coalesce(1).write.mode("append" if append else "errorifexists").option("header", True).csv(path)


def grouped_csv(df: DataFrame, path: str, group: str, order: list[str], parts: int = 1) -> None:
    """A folder of CSV for each group, sorted within files. ``parts`` > 1 spreads each group over that many files by ranges of the order,
    for groups too large for one task."""
    if parts == 1:
        dealt = df.repartition(group)
    else:
        dealt = df.repartitionByRange(parts, *[F.col(c) for c in order])
    dealt.sortWithinPartitions(group, *order).write.option("header", True).partitionBy(group).csv(path)


def json_file(spark: SparkSession, values: dict, path: str) -> None:
    """A small document, through the file system that holds ``path``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps(values, indent=2, sort_keys=True, default=str).encode()))
    finally:
        out.close()


def bundle(tables: dict[str, DataFrame], path: str, parameters: dict | None = None) -> None:
    """Tables that belong together, each in a folder of its own, and their parameters."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    if tables:
        json_file(next(iter(tables.values())).sparkSession, parameters or {}, f"{path}/parameters.json")


def fingerprint(**values) -> str:
    """A name for a stage's inputs and parameters."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()[:16]


def stage(spark: SparkSession, path: str, key: str, build) -> DataFrame:
    """What ``build`` gives, written under its key; read again where a complete one with that key is there."""
    folder = f"{path}/{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def published(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A finished folder copied to ``target``, which must not be there, by Hadoop's file systems; returns what ``outputs`` says of it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, to = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(target)
    if to.getFileSystem(conf).exists(to):
        raise ValueError(f"{target} is there already")
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, to.getFileSystem(conf), to, False, conf)
    return outputs(spark, target)


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of all files below a folder, hidden ones left out; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"))
