"""What the text operators share: columns' names, ids, sizes of tasks, and joins whose keys can be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import map_arrow
from ..functions.storage import Workspace, free_name, shared_folder

__all__ = ["Workspace", "free_name", "integer_id", "join_by_size", "map_arrow", "salted_join", "shared_folder", "split_by_size", "tasks", "wide_key", "without"]

#: A key with more than 1 / MOST_HOT of all rows is hot; so there are fewer than MOST_HOT hot keys, however large the tables.
MOST_HOT = 10_000
#: Rows that a key may have anyway.
FEW = 1000


def tasks(spark: SparkSession, size: int, each: int) -> int:
    """How many partitions hold ``size`` at ``each`` in one, and no fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def integer_id(df: DataFrame, column: str) -> F.Column:
    """The id column as a long. Ids of documents and vectors are integers; another type is an error before anything runs."""
    if not isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{column} must be an integer column, not {df.schema[column].dataType.simpleString()}")
    return df[column].cast("long")


def wide_key(*columns: F.Column) -> F.Column:
    """128 bits of two hashes with different seeds, as binary: rows of other values have another one."""
    part = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns)), 16, "0")
    return F.unhex(F.concat(part(11), part(4242)))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that an operator's results replace: a caller's column of a result's name gives way to it."""
    gone = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in gone])


def split_by_size(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int) -> tuple[DataFrame, DataFrame]:
    """(rows of ``left`` joined with ``right``, rows of ``left`` without a match). ``right`` has unique keys and, in ``size``, how many of
    the ``total`` rows of ``left`` have each.

    Hot keys are joined where their rows are, by a broadcast of fewer than ``MOST_HOT`` rows; only the others are shuffled, so no task gets
    all rows of a frequent key."""
    limit = max(FEW, total // MOST_HOT)
    hot, cold = right.where(F.col(size) > limit), right.where(F.col(size) <= limit)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    both = left.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))
    return both, rest.join(cold.select(*on), on, "left_anti")


def join_by_size(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """The first part of ``split_by_size``."""
    return split_by_size(left, right, on, size, total)[0]


def salted_join(left: DataFrame, right: DataFrame, on: str, spread: str, sizes: DataFrame, size: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique and whose rows may be large. sizes: keys with, in ``size``, how many of the
    ``total`` rows of ``left`` have each.

    A hot key is dealt into parts by the column ``spread`` and its row of ``right`` repeated for each part; what is broadcast are the hot
    keys alone, fewer than ``MOST_HOT``."""
    limit = max(FEW, total // MOST_HOT)
    parts, salt = free_name("parts", left, right), free_name("salt", left, right)
    hot = F.broadcast(sizes.where(F.col(size) > limit).select(on, F.ceil(F.col(size) / limit).cast("int").alias(parts)))
    many = F.coalesce(parts, F.lit(1))
    dealt = left.join(hot, on, "left").withColumn(salt, F.pmod(F.hash(spread), many)).drop(parts)
    copies = right.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), many - 1))).drop(parts)
    return dealt.join(copies, [on, salt]).drop(salt)
