"""Join-shaped operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, key_col: str, table: DataFrame, key: str, value: str,
           out: str | None = None) -> DataFrame:
    """Left-outer lookup; a missing key maps to itself (``map.get(k, k)``).

    ``table`` must be unique on ``key``.  Spark broadcasts it by its measured
    size in bytes, else shuffles both sides."""
    t = table.select(F.col(key).alias("__lk"), F.col(value).alias("__lv"))
    joined = df.join(t, F.col(key_col) == F.col("__lk"), "left")
    return joined.withColumn(out or key_col, F.coalesce(F.col("__lv"), F.col(key_col))).drop("__lk", "__lv")


def anti_membership(df: DataFrame, col: str, members: DataFrame, member_col: str) -> DataFrame:
    """Rows whose ``col`` is not among ``members`` (left anti join)."""
    m = members.select(F.col(member_col).alias("__m")).distinct()
    return df.join(m, F.col(col) == F.col("__m"), "left_anti")


def semi_membership(df: DataFrame, col: str, members: DataFrame, member_col: str) -> DataFrame:
    """Rows whose ``col`` is among ``members``."""
    m = members.select(F.col(member_col).alias("__m")).distinct()
    return df.join(m, F.col(col) == F.col("__m"), "left_semi")


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a single-row aggregate to every row of
    ``df``.  ``one_row`` is a global aggregate (exactly one row), so the
    broadcast is bounded by construction; joined on a constant key."""
    return (df.withColumn("__one", F.lit(1))
              .join(F.broadcast(one_row.withColumn("__one", F.lit(1))), "__one")
              .drop("__one"))
