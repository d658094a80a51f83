"""Pareto (80/20) tables.

The ranking is aggregated in parallel; only the kept top-``n`` rows
(TakeOrderedAndProject, at most 30) reach the un-partitioned windows, so the
single-partition window never sees more than ``top`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.constants import OUTER_SEP, PARETO_CUT, PARETO_TOP
from visitlens.functions.values import pct
from visitlens.operators.cells import multi_value_ranking, ranked


def pareto_from_ranking(ranking: DataFrame, top: int = PARETO_TOP, cut: float = PARETO_CUT) -> DataFrame:
    """G1-G4 over a (name, cnt) ranking: rank, % of the kept rows' total
    (rounded half-even to 0.1), cumulative % of the *rounded* values (summed
    exactly in tenths), vital = cumulative <= cut.

    ``top`` is required: it bounds the rows that reach the un-partitioned
    windows (a full ranking would land in one task)."""
    if not isinstance(top, int) or top <= 0:
        raise ValueError("pareto needs a positive top-n bound")
    kept = ranked(ranking, top)
    order = Window.orderBy(F.col("cnt").desc(), F.col("name").asc())
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("cnt").over(Window.partitionBy())
    pct10 = F.rint(F.col("cnt") / total * 100 * 10)
    out = (kept.withColumn("pct10", pct10)
               .withColumn("cum10", F.sum("pct10").over(running))
               .withColumn("rank", F.row_number().over(order)))
    return out.select("rank", "name", "cnt",
                      (F.col("pct10") / 10).alias("pct"),
                      (F.col("cum10") / 10).alias("pct_cum"),
                      (F.col("cum10") <= F.lit(cut * 10)).alias("vital"))


def pareto(df: DataFrame, col: str, inner: str = ",", outer: str = OUTER_SEP,
           top: int = PARETO_TOP, cut: float = PARETO_CUT) -> DataFrame:
    """Pareto table of the tokens of a multi-valued column."""
    return pareto_from_ranking(multi_value_ranking(df, col, inner=inner, outer=outer), top, cut)


def pareto_concentration(p: DataFrame) -> DataFrame:
    """vital categories n of N, % of categories that are vital, % of the
    cases they hold."""
    agg = p.agg(F.count_if("vital").alias("n_vital"), F.count(F.lit(1)).alias("n_categories"),
                F.coalesce(F.sum(F.when(F.col("vital"), F.col("cnt"))), F.lit(0)).alias("cases_vital"),
                F.coalesce(F.sum("cnt"), F.lit(0)).alias("cases_total"))
    return agg.select("n_vital", "n_categories",
                      pct(F.col("n_vital"), F.col("n_categories")).alias("pct_categories"),
                      F.col("cases_vital").cast("bigint").alias("cases_vital"),
                      pct(F.col("cases_vital"), F.col("cases_total")).alias("pct_cases"))
