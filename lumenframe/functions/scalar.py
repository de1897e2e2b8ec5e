"""Column expressions used across the operators; all stay inside whole-stage codegen or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom with nulls as 0, and 0 where the denominator isn't positive."""
    top, bottom = F.coalesce(top, F.lit(0.0)), F.coalesce(bottom, F.lit(0.0))
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def size_factor(median: Column, library: Column) -> Column:
    """median / library; an empty library is left as it is (factor 1)."""
    return F.when(library > 0, median / library).otherwise(1.0)


def log_normalised(n: Column, library: Column, target: float) -> Column:
    """log1p(n / max(library, 1) * target); 0 stays 0, so long tables of non-zero counts stay complete."""
    return F.log1p(n / F.greatest(library, F.lit(1.0)) * target)


def coerced(text: Column, default: float = 0.0) -> Column:
    """A number from text, and the default where it is none."""
    return F.coalesce(text.try_cast("double"), F.lit(default))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("yes", "y", "true", "1"), F.lit(False))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("__", *(F.trim(p.cast("string")) for p in parts))


def count_bin(n: Column) -> Column:
    """Right-closed bins of a count."""
    return F.when(n <= 4, "0-4").when(n <= 9, "5-9").when(n <= 29, "10-29").when(n <= 99, "30-99").otherwise(">=100")


def bin_order(label: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in ("0-4", "5-9", "10-29", "30-99", ">=100"))), label).cast("int")


def natural_order(label: Column) -> list[Column]:
    """Sort keys that put numeric labels first, by value, and others after them, by text."""
    return [F.when(label.rlike("^[0-9]+$"), 0).otherwise(1), label.try_cast("bigint"), label]


def unique_names(name: str, order: str, within: list[str] | None = None, mark: str = "_") -> Column:
    """Names with ``mark`` and a number after each repeat of an earlier one."""
    again = F.row_number().over(Window.partitionBy(*(within or []), name).orderBy(order)) - 1
    return F.when(again > 0, F.concat(F.col(name), F.lit(mark), again.cast("string"))).otherwise(F.col(name))


def half_patch(patch: int, upsample: int) -> float:
    """Half the side of the window that a patch is cut from: at least 4, from the rounded side (half to even)."""
    return max(8, round(patch / upsample)) / 2


def patch_window(x: Column, y: Column, patch: int, upsample: int) -> Column:
    """Origin, side and scale of the window around a centre."""
    side = max(8, round(patch / upsample))
    corner = lambda c: (F.bround(c) - side // 2).cast("long")
    return F.struct(corner(x).alias("x0"), corner(y).alias("y0"), F.lit(side).alias("side"), F.lit(patch / side).alias("scale"))


def hashed_order(key: Column, seed: int = 0) -> Column:
    """A fixed pseudo-random order of integers that any SQL engine can compute."""
    return (key * 2654435761 + seed) % 1000003


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column, floor: float = 1e-8) -> Column:
    """The vector over its length, which counts as ``floor`` at least; non-finite components are 0."""
    clean = finite(a)
    length = F.greatest(norm(clean), F.lit(floor))
    return F.transform(clean, lambda x: x / length)


def finite(a: Column) -> Column:
    def fix(x: Column) -> Column:
        x = x.cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)

    return F.transform(a, fix)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def mean_vector(a: Column, b: Column) -> Column:
    """The mean of two vectors, normalised again."""
    return l2_normalised(F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))
