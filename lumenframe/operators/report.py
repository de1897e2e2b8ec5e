"""Reporting tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .quantiles import beside, quantiles


def sizes(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str], prefix: str = "") -> DataFrame:
    """Counts by row with one column for each value; one pass, as the values are given."""
    hits = [F.count_if(F.coalesce(F.col(column) == v, F.lit(False))).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(row).agg(*hits)


def row_percent(table: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    total = sum((F.col(c) for c in columns), F.lit(0))
    return table.withColumns({c: F.round(F.when(total > 0, F.lit(100.0).cast("double") * F.col(c) / total).otherwise(0.0), digits) for c in columns})


def statistics(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """mean, median, sample standard deviation and count by key; only keys that occur. Null values don't count, null keys are a key, and an
    empty table gives no rows."""
    r = lambda c: F.round(c, digits)
    sums = df.groupBy(*keys).agg(r(F.avg(value)).alias("mean"), r(F.stddev_samp(value)).alias("std"), F.count(value).alias("n"))
    both = beside(sums, quantiles(df, keys, value, [0.5]), keys)
    return both.select(*keys, "mean", r(F.col("q")[0]).alias("median"), "std", "n")


def distribution(df: DataFrame, keys: list[str], value: str, low: float = 20, digits: int = 6) -> DataFrame:
    """n, least, quantiles at 1, 5 and 25 %, median, mean, most, and how many and what share are below ``low``, by key. Null values don't count,
    null keys are a key, and an empty table gives no rows."""
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"),
        F.count_if(F.col(value) < low).alias("n_low"), F.avg((F.col(value) < low).cast("double")).alias("fraction_low"),
    )
    out = beside(out, quantiles(df, keys, value, [0.01, 0.05, 0.25, 0.5]), keys)
    r = lambda c: F.round(c, digits)
    shown = [r(F.col("q")[i]).alias(n) for i, n in enumerate(("q01", "q05", "q25", "median"))]
    return out.select(*keys, "n", r("least").alias("least"), *shown, r("mean").alias("mean"), r("most").alias("most"), "n_low", r("fraction_low").alias("fraction_low"))


def rank_descending(df: DataFrame, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Ranks from 1, equals share the least, computed on aggregated tables."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*(keys or [])).orderBy(F.desc(value))).cast("long"))


def fractions(df: DataFrame, group: str, label: str) -> DataFrame:
    """n of each label in a group, the group's total, and the fraction."""
    n = sizes(df, group, label)
    total = F.sum("n").over(Window.partitionBy(group))
    return n.withColumns({"total": total, "fraction": F.round(F.col("n") / total, 6)})


def majority(df: DataFrame, group: str, label: str) -> DataFrame:
    """The most frequent label of each group, of equals the first, with its fraction."""
    ranked = fractions(df, group, label).withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), label)))
    return ranked.where("k = 1").drop("k")


def numbered_labels(df: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """Labels numbered from 1 by size, with their sizes and median positions."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    for name, c in (("x", x), ("y", y)):
        middle = quantiles(df, [label], c, [0.5]).select(label, F.round(F.col("q")[0], 6).alias(name))
        n = beside(n, middle, [label])
    return n.withColumn("number", F.row_number().over(Window.orderBy(F.desc("n"), label)).cast("long"))


def review_template(table: DataFrame, cluster: str | None = None, count: str | None = None) -> DataFrame:
    """Cluster sizes with empty columns for a reviewer; the first and last column unless named."""
    cluster = cluster if cluster in table.columns else table.columns[0]
    count = count if count in table.columns else table.columns[-1]
    blank = [F.lit("").alias(c) for c in ("lobulated_neutrophil_morphology", "confirmed_neutrophil", "reviewer", "review_notes")]
    return table.select(F.col(cluster).cast("string").alias("image_cluster"), F.col(count).cast("long").alias("n_cells"), *blank)


def in_natural_order(df: DataFrame, label: str) -> DataFrame:
    return df.orderBy(*S.natural_order(F.col(label).cast("string")))


def positions(df: DataFrame, label: str, name: str) -> DataFrame:
    """Labels' places on an axis: their natural order, from 0."""
    order = Window.orderBy(*S.natural_order(F.col(label).cast("string")))
    return df.select(label).distinct().withColumn(name, (F.row_number().over(order) - 1).cast("long"))


def closest_to_target(df: DataFrame, value: str, target: float, key: str) -> DataFrame:
    """The row whose value is closest to a target, of equals the one of the least key."""
    best = F.min_by(F.struct(*df.columns), F.struct(F.abs(F.col(value) - target), F.col(key)))
    return df.agg(best.alias("best")).where("best is not null").select("best.*")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    rows = cells.groupBy(a).agg(F.sum("n").alias("ra"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("cb"))
    total = Window.partitionBy()
    whole = cells.withColumn("t", F.sum("n").over(total)).join(rows, a).join(columns, b)
    joint = whole.agg(F.sum(pairs(F.col("n"))).alias("ab"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ra") * F.col("cb")))).alias("mi"), F.max("t").alias("t"))

    def margin(table: DataFrame, c: str) -> tuple[Column, ...]:
        t = F.sum(c).over(total)
        return table.withColumn("t", t).agg(F.sum(pairs(F.col(c))).alias(f"{c}_pairs"), (-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(f"{c}_h"))

    parts = joint.unionByName(margin(rows, "ra"), allowMissingColumns=True).unionByName(margin(columns, "cb"), allowMissingColumns=True)
    one = parts.agg(*(F.max(c).alias(c) for c in parts.columns))  # each part is one row with columns of its own
    expected = F.col("ra_pairs") * F.col("cb_pairs") / pairs(F.col("t"))
    most = (F.col("ra_pairs") + F.col("cb_pairs")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("ab") - expected) / (most - expected))
    mean_h = (F.col("ra_h") + F.col("cb_h")) / 2
    nmi = F.when(mean_h == 0, 1.0).otherwise(F.col("mi") / mean_h)
    return one.select(F.round(ari, 6).alias("ari"), F.round(nmi, 6).alias("nmi"))
