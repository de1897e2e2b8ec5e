"""Tables that a job writes to the cluster's shared folder, to cut lineage or to read them more than once."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With this setting Spark deletes a query's shuffle files when the query ends, instead of when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="lumenframe-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, as in tests, a temporary one, but only if all executors are threads of this
    process: on a cluster no other machine would see it, so there an unset folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{_own_folder()}"
    return folder.rstrip("/")


class Workspace:
    """Tables that one run of an operator writes and reads again.

    A saved table cuts lineage at files that every executor sees, so losing an executor costs only the tasks it ran. Tables are
    deleted by ``drop``; what the returned DataFrame of an operator still reads stays until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` written and read again; ``by`` names a column of few values, each of which gets a folder that can be read alone."""
        self._made += 1
        path = f"{self.root}/{self._made}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy(by) if by else writer).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._saved_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing reads any more; others and None are left alone."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            if getattr(table, "_saved_at", None):
                path = jvm.org.apache.hadoop.fs.Path(table._saved_at)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(wanted: str, *tables: DataFrame) -> str:
    """``wanted``, or with a number if some table has such a column (in any case of letters)."""
    taken = {c.lower() for t in tables for c in t.columns}
    name, n = wanted, 1
    while name.lower() in taken:
        name, n = f"{wanted}_{n}", n + 1
    return name
