"""Boundary centroids of vertices that arrive in files, with state kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def centroids(vertices: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Running means by key; only sums and counts are state, so a key's size doesn't matter."""
    return vertices.groupBy(*keys).agg(F.avg(x).alias("x_centroid"), F.avg(y).alias("y_centroid"), F.count("*").alias("n_boundary_vertices"))


def numbered(vertices: DataFrame, key: str, order: str) -> DataFrame:
    """``vertices`` with vertex_id: a vertex's place in its polygon, from 0, carried on from one micro-batch to the next.

    The state of a key is how many vertices it has had. Within a micro-batch vertices go by ``order``; one polygon's vertices of one
    micro-batch are held in memory. Rows with a null key are a polygon of their own."""
    names = vertices.columns
    schema = T.StructType([*vertices.schema.fields, T.StructField("vertex_id", T.LongType())])

    def number(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")[names]
        rows["vertex_id"] = np.arange(before, before + len(rows))
        state.update((before + len(rows),))
        yield rows

    return vertices.groupBy(key).applyInPandasWithState(number, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def write_numbered(vertices: DataFrame, key: str, order: str, path: str, checkpoint: str) -> None:
    """``numbered`` to Parquet files at ``path``, all that there is, in micro-batches."""
    query = numbered(vertices, key, order).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run(vertices: DataFrame, keys: list[str], x: str, y: str, name: str, checkpoint: str) -> DataFrame:
    """The centroids of all there is, in micro-batches, as a table in memory; equal to the batch form."""
    query = centroids(vertices, keys, x, y).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return vertices.sparkSession.table(name)
