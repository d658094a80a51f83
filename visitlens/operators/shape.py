"""Schema operators (B1-B10).  Decisions about which columns exist are taken
on the driver from ``df.columns`` while the plan is built; no data moves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions.text import strip


def strip_headers(df: DataFrame) -> DataFrame:
    """B2: trim whitespace around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def rename_headers(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """B1: rename alias headers; aliases that are absent are ignored."""
    present = {k: v for k, v in aliases.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def ensure_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add a missing column with its default, else fill its NULLs with it."""
    cols = {}
    for c, d in defaults.items():
        cols[c] = F.coalesce(F.col(f"`{c}`"), F.lit(d)) if c in df.columns else F.lit(d)
    return df.withColumns(cols)


def first_existing(df: DataFrame, candidates: list[str], default=None) -> Column:
    """The first candidate column that exists, else the default literal."""
    for c in candidates:
        if c in df.columns:
            return F.col(f"`{c}`")
    return F.lit(default)


def select_existing(df: DataFrame, cols: list[str], insert: tuple[int, str] | None = None) -> DataFrame:
    """Projection that skips absent columns and keeps the requested order;
    ``insert=(pos, col)`` places an optional column at a position."""
    wanted = list(cols)
    if insert is not None and insert[1] in df.columns:
        wanted.insert(insert[0], insert[1])
    return df.select([F.col(f"`{c}`") for c in wanted if c in df.columns])


def relabel(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rename to display labels (absent columns ignored)."""
    return rename_headers(df, labels)


def drop_empty_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows whose (raw) columns are all NULL."""
    return df.dropna(how="all", subset=cols)


def match_columns(df: DataFrame, include: list[str], exclude: list[str] | None = None) -> list[str]:
    """Columns whose name contains any ``include`` and no ``exclude`` substring."""
    exclude = exclude or []
    return [c for c in df.columns
            if any(s in c for s in include) and not any(s in c for s in exclude)]


def has_case(c: str = "case_ids") -> Column:
    """The row has at least one case id."""
    return F.coalesce(strip(F.col(c)) != "", F.lit(False))


def row_total(a: str = "men", b: str = "women") -> Column:
    """``coalesce(a,0) + coalesce(b,0)``."""
    return F.coalesce(F.col(a), F.lit(0.0)) + F.coalesce(F.col(b), F.lit(0.0))


def and_all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)
