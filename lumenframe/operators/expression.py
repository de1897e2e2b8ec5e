"""Count tables in long form: (cell, gene, n) without zero rows, and all cells beside it. Zeros are implied everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.storage import Workspace
from .quantiles import median as exact_median


def libraries(cells: DataFrame, counts: DataFrame, cell: str = "cell_id", n: str = "n") -> DataFrame:
    """Every cell with its count sum; 0 for cells without counts."""
    total = counts.groupBy(cell).agg(F.sum(n).cast("double").alias("library"))
    return cells.join(total, cell, "left").withColumn("library", F.coalesce("library", F.lit(0.0)))


def normalised(counts: DataFrame, library: DataFrame, cell: str = "cell_id", n: str = "n", keep: tuple[str, ...] = ()) -> DataFrame:
    """counts with ``value`` = log1p(n * median / library): size factors by the exact median of the positive libraries, all genes. Counts of
    cells that aren't in ``library`` are left out; a cell with an empty library keeps its counts as they are."""
    factor = library.select(cell, "library", *keep)
    median = exact_median(library.where("library > 0"), "library")
    return counts.join(factor, cell).withColumn("value", F.log1p(F.col(n) * S.size_factor(median, F.col("library"))))


def cluster_gene(cells: DataFrame, counts: DataFrame, cluster: str = "cluster", gene: str = "gene", cell: str = "cell_id") -> DataFrame:
    """Of each cluster and gene: n_cells, mean and median of the normalised values, per cent of cells with any, and the raw sum.

    Means and medians are over all cells of the cluster, zeros included: the sum is divided by their number, and in the order of
    values the zeros come first. Every pair of a cluster and a gene has a row; an empty table gives none. Cells without a cluster are a cluster
    of their own, null. Equal values are counted before they are ordered, and only for pairs where most cells have the gene - in the
    others the median is 0 - so what is sorted by pair are distinct values."""
    work = Workspace(cells.sparkSession, "dotplot")
    counts = work.save(counts.select(cell, gene, "n"))
    library = work.save(libraries(cells.select(cell, cluster), counts, cell))
    values = work.save(normalised(counts, library, cell, keep=(cluster,)).where("n > 0"))  # read three times
    n_cells = cells.groupBy(cluster).agg(F.count("*").alias("n_cells"))
    found = values.groupBy(cluster, gene).agg(F.sum("value").alias("total"), F.count("*").alias("positive"), F.sum("n").alias("raw"))
    same = [F.col(f"a.{cluster}").eqNullSafe(F.col(f"b.{cluster}")), F.col(f"a.{gene}") == F.col(f"b.{gene}")]
    most = found.join(n_cells.withColumnRenamed(cluster, "of"), F.col(cluster).eqNullSafe(F.col("of"))).where(2 * F.col("positive") >= F.col("n_cells"))
    most = most.select(cluster, gene, "n_cells", (F.col("n_cells") - F.col("positive")).alias("zeros"))
    distinct = values.groupBy(cluster, gene, "value").agg(F.count("*").alias("m"))
    distinct = distinct.alias("a").join(most.alias("b"), same[0] & same[1]).select(f"a.{cluster}", f"a.{gene}", "value", "m", "n_cells", "zeros")
    upto = F.col("zeros") + F.sum("m").over(Window.partitionBy(cluster, gene).orderBy("value"))
    placed = distinct.withColumn("upto", upto)
    low, high = F.floor((F.col("n_cells") + 1) / 2), F.ceil((F.col("n_cells") + 1) / 2)
    holds = lambda place: F.when((F.col("upto") >= place) & (F.col("upto") - F.col("m") < place), F.col("value")).otherwise(0.0)
    medians = placed.groupBy(cluster, gene).agg(F.sum((holds(low) + holds(high)) / 2).alias("median"))
    found = found.alias("a").join(medians.alias("b"), same[0] & same[1], "left").select(f"a.{cluster}", f"a.{gene}", "total", "positive", "raw", "median")
    genes = counts.select(gene).distinct()
    grid = n_cells.withColumn("one", F.lit(1)).join(genes.withColumn("one", F.lit(1)), "one").drop("one")  # clusters by genes: dictionaries
    out = grid.alias("a").join(found.alias("b"), same[0] & same[1], "left").select(f"a.{cluster}", f"a.{gene}", "n_cells", "total", "positive", "raw", "median")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        cluster, gene, "n_cells",
        F.round(zero(F.col("total")) / F.col("n_cells"), 6).alias("mean_log1p"),
        F.round(zero(F.col("median")), 6).alias("median_log1p"),
        F.round(100 * zero(F.col("positive").cast("double")) / F.col("n_cells"), 6).alias("pct_positive"),
        zero(F.col("raw").cast("double")).alias("raw_sum"),
    )


def gene_per_cell(cells: DataFrame, counts: DataFrame, genes: DataFrame, name: str, cell: str = "cell_id") -> DataFrame:
    """The normalised value of one gene in every cell; the name is matched without case, the last of equals counts."""
    wanted = genes.where(F.upper("gene") == name.upper()).agg(F.max_by("gene", "gene_idx").alias("gene")).where("gene is not null")
    library = libraries(cells, counts, cell)
    values = normalised(counts.join(F.broadcast(wanted), "gene"), library, cell)
    return cells.select(cell).join(values.select(cell, "value"), cell, "left").select(cell, F.round(F.coalesce("value", F.lit(0.0)), 6).alias("value"))


def scaling(cells: DataFrame, counts: DataFrame, gene: str = "gene", cell: str = "cell_id") -> DataFrame:
    """Mean and population standard deviation of each gene's normalised values over all cells; variance and deviation have floors."""
    values = normalised(counts, libraries(cells, counts, cell), cell)
    sums = values.groupBy(gene).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    moments = sums.withColumn("cells", cells.agg(F.count("*")).scalar()).withColumn("mean", F.col("s") / F.col("cells"))
    variance = F.greatest(F.col("ss") / F.col("cells") - F.col("mean") * F.col("mean"), F.lit(1e-12))
    return moments.select(gene, "mean", F.greatest(F.sqrt(variance), F.lit(1e-6)).alias("std"))


def shifted_scores(values: DataFrame, stats: DataFrame, gene: str = "gene", limit: float = 10.0) -> DataFrame:
    """Clipped z-scores less those of zero, so that rows without counts stay absent: a shift leaves covariances as they are."""
    z = lambda x: S.clipped((x - F.col("mean")) / F.col("std"), -limit, limit)
    zero = z(F.lit(0.0))
    return values.join(stats, gene).withColumns({"score": z(F.col("value")) - zero, "score_of_zero": zero})


def label_sums(cells: DataFrame, counts: DataFrame, label: str, most: int, order: list[Column], cell: str = "cell_id", gene: str = "gene") -> DataFrame:
    """Count sums by label and gene over at most ``most`` cells a label."""
    used = cells.withColumn("k", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("k") <= most).select(cell, label)
    return counts.join(used, cell).groupBy(label, gene).agg(F.sum("n").alias("n"))


def shared_genes(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """Genes of both dictionaries, numbered in the order of the second; too few raise."""
    both = b.join(a.select("gene").distinct(), "gene", "left_semi")
    if (n := both.count()) < least:
        raise ValueError(f"only {n} genes in common, {least} are needed")
    return both


def wide_to_long(table: DataFrame, key: str, name: str = "gene", value: str = "n") -> DataFrame:
    return table.unpivot([key], [c for c in table.columns if c != key], name, value)
