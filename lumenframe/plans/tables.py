"""The driver tables in the roles of cells, genes, counts, clusters, samples and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells: status as sample, priority as cluster."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("sample_id"), F.col("o_orderpriority").alias("cluster"), F.col("o_totalprice").alias("area"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by order and brand as counts by cell and gene."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return joined.groupBy(F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("n"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with transcripts, control and total from their lines; 0 without any."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"))
    sums = lines.agg(F.sum("l_quantity").alias("transcripts"), F.round(F.sum("l_tax"), 6).alias("control"), F.sum("l_quantity").alias("total"))
    return cells(spark, sf_dir).join(sums, "cell_id", "left").fillna(0.0, ["transcripts", "control", "total"])


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their halves as two modalities, doubles."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("embedding"), F.slice(v, 1, 32).alias("rna"), F.slice(v, 33, 32).alias("image"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a plane: key, sample, and coordinates from price and day."""
    o = table(spark, sf_dir, "orders")
    x, y = F.round(F.pmod("o_totalprice", F.lit(5000.0)), 2), F.pmod(F.col("o_orderkey") * 7919, F.lit(5000)).cast("double")
    return o.select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("sample_id"), x.alias("x"), y.alias("y"))


#: The same in DuckDB's SQL, as common table expressions.
CELLS_SQL = "cells as (select o_orderkey as cell_id, o_orderstatus as sample_id, o_orderpriority as cluster, o_totalprice as area from orders)"
COUNTS_SQL = "counts as (select l_orderkey as cell_id, p_brand as gene, sum(l_quantity) as n from lineitem join part on l_partkey = p_partkey group by 1, 2)"
MEASURED_SQL = (
    CELLS_SQL
    + """, sums as (select l_orderkey as cell_id, sum(l_quantity) as transcripts, round(sum(l_tax), 6) as control, sum(l_quantity) as total from lineitem group by 1),
    measured as (select c.*, coalesce(transcripts, 0) as transcripts, coalesce(control, 0) as control, coalesce(total, 0) as total from cells c left join sums using (cell_id))"""
)
VALUES_SQL = (
    f"{CELLS_SQL}, {COUNTS_SQL}"
    + """, library as materialized (select c.cell_id, c.cluster, c.sample_id, coalesce(sum(n), 0) as library from cells c left join counts using (cell_id) group by 1, 2, 3),
    med as (select median(library) as m from library where library > 0),
    vals as materialized (select cell_id, cluster, sample_id, gene, n, ln(1 + n * case when library > 0 then m / library else 1 end) as value from counts join library using (cell_id), med)"""
)
HALVES_SQL = "halves as (select vec_id, label, embedding::double[] as embedding, (embedding::double[])[1:32] as rna, (embedding::double[])[33:64] as image from embeddings)"
POINTS_SQL = "points as (select o_orderkey as cell_id, o_orderstatus as sample_id, round(o_totalprice % 5000.0, 2) as x, ((o_orderkey * 7919) % 5000)::double as y from orders)"
