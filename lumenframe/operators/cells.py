"""Cell tables: quality control, edges, retention, caps, boundaries and keyed joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.storage import Workspace, free_name
from .quantiles import quantiles
from .validate import require_matched, require_unique


def quality_control(df: DataFrame, least: float, most_control: float, q_low: float, q_high: float, sample: str = "sample_id", area: str = "area", count: str = "transcripts", control: str = "control", total: str = "total") -> DataFrame:
    """Cells with enough transcripts, few controls, and an area within its sample's quantiles; nulls don't pass.

    The quantiles are one small row per sample, found by rank and joined back. Cells of a null sample don't pass; an empty table gives no rows."""
    with_fraction = df.withColumn("control_fraction", S.safe_ratio(F.col(control), F.col(total)))
    limits = quantiles(df, [sample], area, [q_low, q_high], "limits")
    passed = with_fraction.join(limits, sample).where((F.col(count) >= least) & (F.col("control_fraction") <= most_control) & F.col(area).between(F.col("limits")[0], F.col("limits")[1]))
    return passed.drop("limits")


def pixel_position(df: DataFrame, um_per_px: Column, x: str = "x_centroid", y: str = "y_centroid") -> DataFrame:
    return df.withColumns({"x_px": F.col(x) / um_per_px, "y_px": F.col(y) / um_per_px})


def inside_edges(df: DataFrame, width: Column, height: Column, patch: int, upsample: int) -> DataFrame:
    """Cells whose patch lies in the image: half-open at the far sides."""
    half = S.half_patch(patch, upsample)
    return df.where((F.col("x_px") >= half) & (F.col("y_px") >= half) & (F.col("x_px") < width - half) & (F.col("y_px") < height - half))


def in_box(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Half-open crop window."""
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def any_vertex_in_view(vertices: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether some vertex (struct of x and y) lies in the closed box."""
    return F.exists(vertices, lambda v: v["x"].between(x0, x1) & v["y"].between(y0, y1))


def with_retention(df: DataFrame, confirmed: Column, count: Column, least: float) -> DataFrame:
    """confirmed, passes and retention_reason of each row: confirmed rows stay whatever their count."""
    sure, passes = F.coalesce(confirmed, F.lit(False)), F.coalesce(count.try_cast("double") if hasattr(count, "try_cast") else count, F.lit(0.0)) >= least
    reason = F.when(sure & passes, "confirmed_and_count").when(sure, "confirmed").when(passes, "count").otherwise("dropped")
    return df.withColumns({"confirmed": sure, "passes": passes, "retention_reason": reason})


def retained(df: DataFrame) -> DataFrame:
    return df.where("confirmed or passes")


def check_retention(source: DataFrame, kept: DataFrame, gone: DataFrame) -> DataFrame:
    """``kept``, if it and ``gone`` make up ``source`` (rows with confirmed and passes) and no confirmed row is gone; else ValueError."""
    sure = gone.where("confirmed").count()
    if sure:
        raise ValueError(f"{sure} confirmed rows are dropped")
    sizes = [df.count() for df in (source, kept, gone)]
    if sizes[0] != sizes[1] + sizes[2]:
        raise ValueError(f"{sizes[1]} kept and {sizes[2]} dropped rows don't make up {sizes[0]}")
    return kept


def dropped(df: DataFrame) -> DataFrame:
    return df.where("not (confirmed or passes)")


def stratified_cap(df: DataFrame, sample: str, low: Column, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows a sample, but every low one: the rest fills what these leave, in the given order.

    Low rows are counted and passed on; only the others are ranked, and of these Spark keeps no more than ``most`` of a sample in any
    task before they are shuffled. A null flag is not low; rows without a sample are a sample of their own."""
    flag, rank, room = (free_name(n, df) for n in ("the_low", "the_rank", "the_room"))
    marked = df.withColumn(flag, F.coalesce(low, F.lit(False)))
    kept, rest = marked.where(flag), marked.where(~F.col(flag))
    ranked = rest.withColumn(rank, F.row_number().over(Window.partitionBy(sample).orderBy(*order))).where(F.col(rank) <= most)
    of = free_name("the_sample", df)
    taken = kept.groupBy(F.col(sample).alias(of)).agg(F.count("*").alias(room))
    filled = ranked.join(taken, F.col(sample).eqNullSafe(F.col(of)), "left").where(F.col(rank) <= most - F.coalesce(room, F.lit(0)))
    return kept.select(*df.columns).unionByName(filled.select(*[ranked[c] for c in df.columns]))


def sample_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, number: str | None = None) -> DataFrame:
    """n rows of each group (all of a smaller one), without replacement; ``number`` counts them from 0. Null keys are a group."""
    rank = free_name("the_rank", df)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
    return (ranked.withColumn(number, F.col(rank) - 1) if number else ranked).drop(rank)


def split(df: DataFrame, key: Column, share: float) -> DataFrame:
    """``part``: train for about a share of the rows, chosen by a hash of the key, else validation."""
    return df.withColumn("part", F.when(S.hashed_order(key, 17) < int(share * 1000003), "train").otherwise("validation"))


def vertex_ids(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """vertex_id: the place of a vertex in its polygon, from 0, in file order."""
    return df.withColumn("vertex_id", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def centroids(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Means of the vertices (a repeated closing vertex counts twice) and how many; partial sums merge."""
    return df.groupBy(*keys).agg(F.avg(x).alias("x_centroid"), F.avg(y).alias("y_centroid"), F.count("*").alias("n_boundary_vertices"))


def polygons(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """One row a polygon with its vertices in order; a polygon is small, so it fits a row."""
    points = F.sort_array(F.collect_list(F.struct("vertex_id", F.col(x).alias("x"), F.col(y).alias("y"))))
    return df.groupBy(*keys).agg(points.alias("vertices"))


def to_patch(vertices: Column, window: Column) -> Column:
    """Vertices in the coordinates of a patch window."""
    return F.transform(vertices, lambda v: F.struct(((v["x"] - window["x0"]) * window["scale"]).alias("x"), ((v["y"] - window["y0"]) * window["scale"]).alias("y")))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", complete: bool = True) -> DataFrame:
    """A join of unique keys; ``complete``: every left row must have a match."""
    require_unique(left, keys, "left side")
    require_unique(right, keys, "right side")
    if complete:
        require_matched(left, right, keys)
    return left.join(right, keys, how)


def with_centroids(cells: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that have a boundary, with its centroid in place of any they had."""
    return cells.drop("x_centroid", "y_centroid", "n_boundary_vertices").join(centres, keys)


def union_samples(*tables: DataFrame, dictionaries: list[DataFrame] | None = None) -> DataFrame:
    """UNION ALL of samples by name; their gene dictionaries (gene_idx, gene) must be equal."""
    for other in (dictionaries or [])[1:]:
        if not dictionaries[0].exceptAll(other).isEmpty() or not other.exceptAll(dictionaries[0]).isEmpty():
            raise ValueError("gene dictionaries differ between samples")
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def row_index(df: DataFrame, order: list[str], name: str = "source_row_index") -> DataFrame:
    """Dense numbers from 0 in an order, without sorting everything in one task: rows are ranged over partitions, numbered within them, and
    the partitions' offsets, one small row each, are added. The ranged rows are saved, as the numbering and the sizes must see the same partitions:
    Spark joins small partitions by the bytes that a plan reads, so in two plans over the ranges a row may lie in different ones."""
    part, place, size, offset = (free_name(n, df) for n in ("the_part", "the_place", "the_size", "the_offset"))
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn(part, F.spark_partition_id())
    ranged = Workspace(df.sparkSession, "ranges").save(ranged)
    within = ranged.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    sizes = within.groupBy(part).agg(F.count("*").alias(size))
    offsets = sizes.withColumn(offset, F.coalesce(F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(offsets.select(part, offset), part).withColumn(name, F.col(offset) + F.col(place) - 1).drop(part, place, offset)


def mapped(df: DataFrame, column: str, pairs: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the value of its ``column`` in a table of unique keys; a repeated key or a value without one raises."""
    require_unique(pairs, [key], "map")
    of, found = free_name("the_key", df, pairs), free_name("the_value", df, pairs)
    known = pairs.select(F.col(key).alias(of), F.col(value).alias(found))
    if missing := df.join(known, df[column] == known[of], "left_anti").select(column).distinct().limit(5).collect():
        raise ValueError(f"no value for {[r[0] for r in missing]}")
    return df.join(known, df[column] == known[of]).drop(of).withColumn(name, F.col(found)).drop(found)


def joined_if_complete(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, if every row of it has a match there; else ``left`` alone."""
    require_unique(right, keys, "right side")
    return left.join(right, keys) if left.join(right, keys, "left_anti").isEmpty() else left


def present_in(df: DataFrame, keys: list[str], counted: DataFrame) -> DataFrame:
    """Rows whose key is in another table: cells that the count matrix has."""
    return df.join(counted.select(*keys).distinct(), keys, "left_semi")


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null (or NaN) in the columns: cells with coordinates and a cluster."""
    return df.dropna(subset=columns)


def with_polygon_ids(vertices: DataFrame, polygon: str = "polygon_id", vertex: str = "vertex_id") -> DataFrame:
    """Polygon and vertex numbers as integers: 1 and 0 where they are missing, as columns or as values."""
    out = vertices
    for name, default in ((polygon, 1), (vertex, 0)):
        out = out.withColumn(name, F.coalesce(F.col(name).cast("double").cast("long"), F.lit(default).cast("long")) if name in vertices.columns else F.lit(default).cast("long"))
    return out


def exact_split(df: DataFrame, order: list[Column], share: float) -> DataFrame:
    """``part``: train for exactly floor(share * n) rows, one at least, the first in a fixed pseudo-random order, else validation; where that
    leaves no row for validation, all are both: part is "both"."""
    n = df.count()
    cut, rank = max(1, int(share * n)), free_name("the_rank", df)
    hashed = free_name("the_order", df)
    numbered = row_index(df.withColumn(hashed, F.xxhash64(*order)), [hashed], rank)
    part = F.lit("both") if cut >= n else F.when(F.col(rank) < cut, "train").otherwise("validation")
    return numbered.withColumn("part", part).drop(rank, hashed)
