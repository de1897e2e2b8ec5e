"""Exact quantiles by rank, without a group's values in one place.

Equal values are counted first. What is left - distinct values of groups - is cut into ranges of about equal size over all groups, and saved. The sums of
ranges tell in which range of a group a rank lies, so that only these ranges are read again, and each is ordered by itself. A group of any size takes
as many ranges as it needs, and no task holds more than one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import Workspace, free_name


def quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, shares: Sequence[float], name: str = "q") -> DataFrame:
    """(keys, name): for each group an array of the quantiles of ``value`` at ``shares``, between two values by linear interpolation.

    Null values count for nothing, and a group without others has no row; null keys are a group; NaN is above all numbers; an empty table gives no
    rows. Without keys there is at most one row."""
    if not all(0 <= s <= 1 for s in shares):
        raise ValueError(f"shares must lie between 0 and 1: {shares}")
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(F.struct(*(keys or [F.lit(0).alias("all")])).alias("g"), value.cast("double").alias("v")).where(F.col("v").isNotNull())
    counted = rows.groupBy("g", "v").agg(F.count("*").alias("m"))
    placed = Workspace(df.sparkSession, "quantiles").save(counted.repartitionByRange("g", "v").select("g", "v", "m", F.spark_partition_id().alias("part")))
    group = Window.partitionBy("g")
    ranges = placed.groupBy("g", "part").agg(F.sum("m").alias("size"))
    ranges = ranges.select("g", "part", "size", F.coalesce(F.sum("size").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(group).alias("n"))
    at = F.transform(F.array(*(F.lit(float(s)) for s in shares)), lambda s: s * (F.col("n") - 1))
    ranks = F.array_distinct(F.concat(F.transform(at, lambda p: F.floor(p)), F.transform(at, lambda p: F.ceil(p))))
    asked = ranges.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))).where(F.size("ranks") > 0)
    inside = placed.join(asked.drop("size"), ["g", "part"])
    upto = F.col("before") + F.sum("m").over(Window.partitionBy("g", "part").orderBy("v"))
    hit = inside.withColumn("upto", upto).withColumn("rank", F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("m")))).where(F.size("rank") > 0)
    found = hit.select("g", "n", "v", F.explode("rank").alias("rank")).groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))
    low, high = (lambda p: F.element_at("of", F.floor(p))), (lambda p: F.element_at("of", F.ceil(p)))
    between = lambda p: F.when(low(p) == high(p), low(p)).otherwise(low(p) + (high(p) - low(p)) * (p - F.floor(p)))
    return found.select(*(F.col("g")[k].alias(k) for k in keys), F.transform(at, between).alias(name))


def beside(table: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the other columns of ``found``, whose keys are unique; null keys are equal."""
    if not keys:
        return table.join(found, how="left") if found.columns else table
    names = {k: free_name(f"{k}_of", table, found) for k in keys}
    right = found.withColumnsRenamed(names)
    same = [table[k].eqNullSafe(right[names[k]]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return table.join(right, condition, "left").drop(*names.values())


def median(df: DataFrame, value: Column | str) -> Column:
    """The exact median of a column, as a subquery of one value; null without any."""
    return quantiles(df, [], value, [0.5]).select(F.col("q")[0]).scalar()
