"""Constraints: each raises ValueError with what is wrong, or returns its input."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of ``columns`` that there are."""
    return df.select(*[c for c in columns if c in df.columns])


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    if repeated := df.groupBy(*keys).count().where("count > 1").limit(5).collect():
        raise ValueError(f"{what} repeats keys {[tuple(r)[:-1] for r in repeated]}")
    return df


def require_matched(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str = "rows") -> None:
    if missing := left.join(right, list(keys), "left_anti").select(*keys).limit(5).collect():
        raise ValueError(f"{what} without a match: {[tuple(r) for r in missing]}")


def require_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], what: str = "tables") -> None:
    """Both have the same keys, each as often."""
    x, y = a.select(*keys), b.select(*keys)
    if not x.exceptAll(y).isEmpty() or not y.exceptAll(x).isEmpty():
        raise ValueError(f"{what} differ in their keys")


def require_same_size(**tables: DataFrame) -> int:
    sizes = {name: df.count() for name, df in tables.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"row counts differ: {sizes}")
    return next(iter(sizes.values()))


def require_finite(df: DataFrame, vector: str) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if not df.where(bad).isEmpty():
        raise ValueError(f"{vector} has non-finite components")
    return df


def require_no_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    if not df.where(F.col(column).startswith(prefix)).isEmpty():
        raise ValueError(f"{column} has values that start with {prefix}")
    return df


@contextlib.contextmanager
def recorded(write: Callable[[dict], None], **context) -> Iterator[None]:
    """Runs a step; an error is written as a document of its kind, its text and the context, and raised again."""
    try:
        yield
    except Exception as error:
        write({"status": "failed", "error": type(error).__name__, "message": str(error)[:2000], **context})
        raise
