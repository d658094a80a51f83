"""Operators over multi-valued cells.

A cell holds a list of lists as text (outer separator ``||`` between cases,
an inner separator that depends on the column).  Each operator projects the
cell (and the key it needs) *before* exploding, so the row multiplication
happens on two narrow columns, and aggregates with Spark's partial
(map-side) aggregation, so a token that holds a third of all rows is
combined per partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.constants import OUTER_SEP
from visitlens.functions.text import _split_only, non_blank_tokens, normalize_text, split_literal

RANKING_SCHEMA = "name string, cnt bigint"


def _empty(df: DataFrame, schema: str) -> DataFrame:
    spark = SparkSession.getActiveSession() or df.sparkSession
    return spark.createDataFrame([], schema)


def explode_tokens(df: DataFrame, col: str, seps: list[str], keep: list[str] | None = None,
                   alias: str = "token") -> DataFrame:
    """One row per non-blank token (stripped at every level); ``keep`` columns ride along."""
    keep = keep or []
    return (df.select(*keep, F.explode(non_blank_tokens(col, seps)).alias(alias)))


def multi_value_ranking(df: DataFrame, col: str, inner: str = ",", outer: str = OUTER_SEP,
                        extra: list[str] | None = None) -> DataFrame:
    """occurrences of each token (not distinct cases — quirk Q11);
    absent column -> empty ranking.  Unordered; see ``ranked``."""
    if col not in df.columns:
        return _empty(df, RANKING_SCHEMA)
    seps = [outer, inner, *(extra or [])]
    return (explode_tokens(df, col, seps, alias="name")
            .groupBy("name").agg(F.count(F.lit(1)).alias("cnt")))


def ranked(ranking: DataFrame, top: int | None = None, count_col: str = "cnt",
           name_col: str = "name") -> DataFrame:
    """F1/H1 order: count descending, ties by name (Q6); optional top-n
    (planned as TakeOrderedAndProject — no global sort)."""
    out = ranking.orderBy(F.col(count_col).desc(), F.col(name_col).asc())
    return out.limit(top) if top is not None else out


def case_ids(df: DataFrame, col: str = "case_ids", keep: list[str] | None = None) -> DataFrame:
    """Distinct-able case ids: split on ``||`` only, stripped, non-blank."""
    return explode_tokens(df, col, [OUTER_SEP], keep=keep, alias="case_id")


def count_distinct_cases(df: DataFrame, col: str = "case_ids", approx: bool = False,
                         rsd: float = 0.01) -> DataFrame:
    """number of distinct case ids (one row, ``n_cases``).  ``approx``
    opts into HyperLogLog++ (``approx_count_distinct``, relative error ``rsd``),
    which needs no shuffle of the ids."""
    if col not in df.columns:
        return df.sparkSession.createDataFrame([(0,)], "n_cases bigint")
    agg = F.approx_count_distinct("case_id", rsd) if approx else F.count_distinct("case_id")
    return case_ids(df, col).agg(agg.alias("n_cases"))


def cases_per_group(df: DataFrame, key: str = "employer", col: str = "case_ids") -> DataFrame:
    """distinct case ids per group; NULL group dropped (Q1).

    Spark plans the distinct count as (key, case) partial dedup -> shuffle ->
    partial count -> shuffle on key, so a hot key only moves one partial
    count per partition in the last exchange."""
    if col not in df.columns or key not in df.columns:
        return _empty(df, f"{key} string, n_cases bigint")
    return (case_ids(df.filter(F.col(key).isNotNull()), col, keep=[key])
            .groupBy(key).agg(F.count_distinct("case_id").alias("n_cases")))


def split_nested_unstripped(col, seps: list[str]):
    """Split level by level *without* stripping between levels (the
    normaliser's extraction does this; normalisation strips afterwards)."""
    arr = split_literal(col, seps[0])
    for sep in seps[1:]:
        arr = F.flatten(F.transform(arr, _split_only(sep)))
    return arr


def atomic_values(df: DataFrame, col: str, outer: str = OUTER_SEP, inner: str = ",") -> DataFrame:
    """distinct normalised non-blank items of a multi-valued column
    (NULL cells skipped).  Column ``value``.

    Raw items are de-duplicated first (map-side), so the six-regex
    normalisation runs once per distinct spelling, not once per occurrence."""
    items = (df.select(F.col(col).cast("string").alias("cell"))
               .filter(F.col("cell").isNotNull())
               .select(F.explode(split_nested_unstripped("cell", [outer, inner])).alias("item"))
               .distinct())
    return (items.select(normalize_text("item").alias("value"))
                 .filter(F.col("value") != "")
                 .distinct())


def atomic_values_by_column(df: DataFrame, seps: dict[str, tuple[str, str]]) -> DataFrame:
    """F20 for several columns in one scan: (column, value) pairs."""
    cols = [c for c in seps if c in df.columns]
    per_col = F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.when(F.col(f"`{c}`").isNull(), F.array().cast("array<string>"))
                  .otherwise(split_nested_unstripped(F.col(f"`{c}`").cast("string"), list(seps[c]))).alias("items"))
        for c in cols])
    items = (df.select(F.explode(per_col).alias("s"))
               .select(F.col("s.column").alias("column"), F.explode("s.items").alias("item"))
               .distinct())
    return (items.select("column", normalize_text("item").alias("value"))
                 .filter(F.col("value") != "")
                 .distinct())
