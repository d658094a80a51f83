"""Counts, KPIs, indicators, crosstab and pillar tables.

All are single ``groupBy``/``agg`` passes with conditional counts, so Spark
runs partial aggregation before the shuffle and a hot group never lands
whole on one task.  Percentages are rounded half-to-even on tenths (C15);
team means are taken over exact integer tenths so every engine agrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.constants import OVERDUE_STATUS, PILLAR_HEADERS
from visitlens.functions.dates import format_date, month_name_es
from visitlens.constants import OUTER_SEP
from visitlens.functions.values import n_pct_label, pct, short_label_text
from visitlens.operators.cells import ranked
from visitlens.operators.lookup import attach_scalars
from visitlens.operators.measures import distinct_of, measure, rows_where, scalars

PILLARS = ["pillar_1", "pillar_2", "pillar_3", "pillar_4"]
PILLAR_LABELS = [short_label_text(h) for h in PILLAR_HEADERS]


def tenths(n, d):
    """``rint(n/d*1000)`` — a percentage in integer tenths (0 when d = 0)."""
    return F.coalesce(F.rint(F.try_divide(n.cast("double"), d) * 100 * 10), F.lit(0.0))


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """rows per non-NULL value (Q1), count descending, ties by value."""
    counts = (df.filter(F.col(col).isNotNull()).groupBy(col)
                .agg(F.count(F.lit(1)).alias("cnt")))
    return ranked(counts, top, name_col=col)


def monthly_load(df: DataFrame) -> DataFrame:
    """visits per month with the Spanish month name, calendar order."""
    return (df.filter(F.col("month").isNotNull()).groupBy("month")
              .agg(F.count(F.lit(1)).alias("cnt"))
              .withColumn("month_name", month_name_es("month"))
              .select("month", "month_name", "cnt").orderBy("month"))


def worker_totals(df: DataFrame) -> DataFrame:
    """F8: men, women and both (NULL as 0), truncated to whole numbers."""
    men = F.sum(F.coalesce(F.col("men"), F.lit(0.0)))
    women = F.sum(F.coalesce(F.col("women"), F.lit(0.0)))
    return df.agg(F.coalesce((men + women), F.lit(0.0)).cast("bigint").alias("total_workers"),
                  F.coalesce(men, F.lit(0.0)).cast("bigint").alias("total_men"),
                  F.coalesce(women, F.lit(0.0)).cast("bigint").alias("total_women"))


def any_flag(cols: list[str]):
    """row-wise OR of flag columns (false when there are none)."""
    if not cols:
        return F.lit(False)
    out = F.coalesce(F.col(cols[0]), F.lit(False))
    for c in cols[1:]:
        out = out | F.coalesce(F.col(c), F.lit(False))
    return out


def specialist_indicators(fu: DataFrame) -> DataFrame:
    """per specialist (NULL dropped): centres, centres with any pillar,
    goal met, % start, % goal, efficiency (goal / started; 0 if none started).
    ``goal10`` keeps % goal in exact integer tenths for team means."""
    pillars = [p for p in PILLARS if p in fu.columns]
    goal = F.col("goal_met") if "goal_met" in fu.columns else F.lit(False)
    agg = (fu.filter(F.col("specialist").isNotNull()).groupBy("specialist")
             .agg(F.count(F.lit(1)).alias("centers"),
                  F.count_if(any_flag(pillars)).alias("with_any"),
                  F.count_if(F.coalesce(goal, F.lit(False))).alias("goals")))
    return agg.select(
        "specialist", "centers", "with_any",
        pct(F.col("with_any"), F.col("centers")).alias("pct_start"),
        "goals",
        pct(F.col("goals"), F.col("centers")).alias("pct_goal"),
        pct(F.col("goals"), F.col("with_any")).alias("efficiency"),
        tenths(F.col("goals"), F.col("centers")).alias("goal10"))


def team_mean(indicators: DataFrame) -> DataFrame:
    """unweighted mean of the (rounded) % goal over specialists, one row
    (``mean_goal10`` in tenths, ``team_mean_pct`` in percent)."""
    m10 = F.try_divide(F.sum("goal10"), F.count(F.lit(1)).cast("double"))
    return indicators.agg(F.coalesce(m10, F.lit(0.0)).alias("mean_goal10")) \
                     .withColumn("team_mean_pct", F.rint(F.col("mean_goal10")) / 10)


def specialist_vs_team(fu_filtered: DataFrame, fu_all: DataFrame) -> DataFrame:
    """F12 + E6 + G6: indicators of the filtered follow-up with the difference
    to the *unfiltered* team mean, in percentage points rounded half-even."""
    ind = specialist_indicators(fu_filtered)
    mean = team_mean(specialist_indicators(fu_all)).select("mean_goal10")
    out = attach_scalars(ind, mean)
    return out.select("specialist", "centers", "with_any", "pct_start", "goals", "pct_goal",
                      (F.rint(F.col("goal10") - F.col("mean_goal10")) / 10).alias("vs_team_pp"),
                      "efficiency")


def specialist_counts(fu: DataFrame, selection: dict) -> DataFrame:
    """One scan of the follow-up: per specialist (NULL dropped), rows and goals of all
    rows, and rows, goals and pillars of those that pass ``selection``."""
    from visitlens.operators.filters import _match
    sel = F.lit(True)
    for c in (_match(fu, k, v) for k, v in selection.items()):
        sel = sel if c is None else sel & c
    pillars = [p for p in PILLARS if p in fu.columns]
    goal = F.coalesce(F.col("goal_met"), F.lit(False)) if "goal_met" in fu.columns else F.lit(False)
    return (fu.filter(F.col("specialist").isNotNull()).groupBy("specialist")
            .agg(F.count(F.lit(1)).alias("centers_all"), F.count_if(goal).alias("goals_all"),
                 F.count_if(sel).alias("centers"), F.count_if(sel & any_flag(pillars)).alias("with_any"),
                 F.count_if(sel & goal).alias("goals"),
                 *[F.count_if(sel & F.coalesce(F.col(p), F.lit(False))).alias(p) for p in pillars]))


def vs_team_of(counts: DataFrame) -> DataFrame:
    """P6 from ``specialist_counts``; the team mean is a global aggregate of that one
    small result."""
    agg = counts.withColumn("goal10_all", tenths(F.col("goals_all"), F.col("centers_all")))
    mean = agg.agg(F.coalesce(F.try_divide(F.sum("goal10_all"), F.count(F.lit(1)).cast("double")),
                              F.lit(0.0)).alias("mean_goal10"))
    out = attach_scalars(agg.filter(F.col("centers") > 0), mean)
    return out.select(
        "specialist", "centers", "with_any",
        pct(F.col("with_any"), F.col("centers")).alias("pct_start"), "goals",
        pct(F.col("goals"), F.col("centers")).alias("pct_goal"),
        (F.rint(tenths(F.col("goals"), F.col("centers")) - F.col("mean_goal10")) / 10).alias("vs_team_pp"),
        pct(F.col("goals"), F.col("with_any")).alias("efficiency"))


def specialist_vs_team_selection(fu: DataFrame, selection: dict) -> DataFrame:
    """P6 in one scan of the follow-up: the indicators of the rows passing
    ``selection`` and the difference to the mean over all rows."""
    return vs_team_of(specialist_counts(fu, selection))


def team_mean_of(counts: DataFrame) -> DataFrame:
    """F13 over all rows, from ``specialist_counts``."""
    return team_mean(counts.select(tenths(F.col("goals_all"), F.col("centers_all")).alias("goal10")))


def _pillar_counts(fu: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("centers")]
    aggs += [F.count_if(F.coalesce(F.col(p), F.lit(False))).alias(p) for p in PILLARS if p in fu.columns]
    return fu.filter(F.col("specialist").isNotNull()).groupBy("specialist").agg(*aggs)


def pillar_progress(fu: DataFrame) -> DataFrame:
    """long table specialist x pillar -> count and % of the specialist's
    centres.  One aggregation, then the four pillar counts as rows."""
    return pillar_progress_of(_pillar_counts(fu))


def pillar_progress_of(counts: DataFrame) -> DataFrame:
    """F14 from (specialist, centers, pillars)."""
    labels = dict(zip(PILLARS, PILLAR_LABELS))
    stacked = F.explode(F.array(*[F.struct(F.lit(labels[p]).alias("pillar"), F.col(p).alias("n"))
                                  for p in PILLARS if p in counts.columns]))
    return (counts.select("specialist", "centers", stacked.alias("s"))
                  .select("specialist", F.col("s.pillar").alias("pillar"), F.col("s.n").alias("n"),
                          pct(F.col("s.n"), F.col("centers")).alias("pct")))


def pivot_pillars(long: DataFrame) -> DataFrame:
    """wide table of ``"n (p%)"`` labels, one column per pillar (explicit
    pivot values: no extra job, fixed schema)."""
    labelled = long.withColumn("label", n_pct_label(F.col("n"), F.col("pct")))
    pillars = [p for p in PILLAR_LABELS]
    return labelled.groupBy("specialist").pivot("pillar", pillars).agg(F.first("label"))


def pillar_wide(fu: DataFrame) -> DataFrame:
    """F14+F15 in one aggregation (no pivot shuffle): the same wide table."""
    return pillar_wide_of(_pillar_counts(fu))


def pillar_wide_of(counts: DataFrame) -> DataFrame:
    """F14+F15 from (specialist, centers, pillars)."""
    labels = dict(zip(PILLARS, PILLAR_LABELS))
    return counts.select("specialist", *[n_pct_label(F.col(p), pct(F.col(p), F.col("centers"))).alias(labels[p])
                                         for p in PILLARS if p in counts.columns])


def crosstab_flag(fu: DataFrame, row: str = "region", flag: str = "goal_met") -> DataFrame:
    """F16: counts of false/true per row value (missing -> 0), NULL rows dropped."""
    f = F.coalesce(F.col(flag), F.lit(False))
    return (fu.filter(F.col(row).isNotNull()).groupBy(row)
              .agg(F.count_if(~f).alias("n_false"), F.count_if(f).alias("n_true")))


def _is_scheduled(month: int | None):
    """Plan rows with a planned date, optionally in one month."""
    sched = F.col("planned_date").isNotNull()
    return sched if month is None else sched & (F.col("month") == month)


def plan_entries(month: int | None = None) -> list:
    """What F17 and F18 count in the plan."""
    return [rows_where("scheduled", _is_scheduled(month)), distinct_of("n_cases", "case_ids", seps=[OUTER_SEP]),
            distinct_of("employers_with_cases", "employer", condition=F.col("has_case"))]


def summary_entries(condition=None, prefix: str = "") -> list:
    """What F19 counts in a subset."""
    return [distinct_of(f"{prefix}n_cases", "case_ids", seps=[OUTER_SEP], condition=condition),
            distinct_of(f"{prefix}n_employers", "employer", condition=condition), rows_where(f"{prefix}n_visits", condition)]


def followup_counts(fu: DataFrame) -> list:
    """What F17 and F18 count in the follow-up; 0 for columns that it lacks."""
    def where(name: str, col: str, condition) -> "F.Column":
        return (F.count_if(F.coalesce(condition, F.lit(False))) if col in fu.columns else F.lit(0).cast("bigint")).alias(name)

    return [F.count(F.lit(1)).alias("fu_rows"), where("goals", "goal_met", F.col("goal_met")),
            where("overdue", "visit_status", F.col("visit_status") == OVERDUE_STATUS), *[where(p, p, F.col(p)) for p in PILLARS]]


def _fu_counts(fu: DataFrame) -> DataFrame:
    return fu.agg(*followup_counts(fu))


def kpi_global(plan: DataFrame, fu: DataFrame, month: int | None = None) -> DataFrame:
    """scheduled visits; goals met and % of the scheduled plan (NULL
    when there is no follow-up data, Q17); distinct cases; employers with
    cases (0 when there is no case).  Populations as in the source (Q8).
    One scan of each table."""
    return kpi_global_of(measure(plan, plan_entries(month)), _fu_counts(fu))


def kpi_global_of(measures: DataFrame, fu_counts: DataFrame) -> DataFrame:
    """F17 from the plan's measures and the follow-up's counts."""
    return kpi_global_row(attach_scalars(scalars(measures, ["scheduled", "n_cases", "employers_with_cases"]), fu_counts))


def kpi_global_row(both: DataFrame) -> DataFrame:
    """F17 from one row of all counts."""
    has_fu = F.col("fu_rows") > 0
    return both.select(
        "scheduled",
        F.when(has_fu, F.col("goals")).alias("goals_met"),
        F.when(has_fu, pct(F.col("goals"), F.col("scheduled"))).alias("goal_pct"),
        "n_cases",
        F.when(F.col("n_cases") > 0, F.col("employers_with_cases")).otherwise(F.lit(0)).cast("bigint")
         .alias("employers_with_cases"))


def kpi_followup(plan: DataFrame, fu: DataFrame, month: int | None = None) -> DataFrame:
    """plan universe, goals, overdue visits, progress % and the four
    pillar sums with their % of the universe."""
    return kpi_followup_of(plan.agg(F.count_if(_is_scheduled(month)).alias("scheduled")), _fu_counts(fu))


def kpi_followup_of(universe: DataFrame, fu_counts: DataFrame) -> DataFrame:
    """F18 from one row with the plan's ``scheduled`` rows and the follow-up's counts."""
    both = attach_scalars(universe, fu_counts)
    cols = [F.col("scheduled").alias("universe"), "goals", "overdue",
            pct(F.col("goals"), F.col("scheduled")).alias("progress_pct")]
    for p_ in PILLARS:
        cols += [F.col(p_).alias(f"{p_}_n"), pct(F.col(p_), F.col("scheduled")).alias(f"{p_}_pct")]
    return both.select(*cols)


def case_summary(df: DataFrame) -> DataFrame:
    """distinct cases, distinct employers and visits of a subset, in one scan."""
    return scalars(measure(df, summary_entries()), ["n_cases", "n_employers", "n_visits"])


def status_count(df: DataFrame, value: str = OVERDUE_STATUS, col: str = "visit_status") -> DataFrame:
    """rows whose status equals ``value``."""
    return df.agg(F.count_if(F.coalesce(F.col(col) == value, F.lit(False))).alias("n"))


def flag_sum(df: DataFrame, cols: list[str], denominator: int | None = None) -> DataFrame:
    """true-count per flag column (and % of ``denominator`` rows if given)."""
    aggs = []
    for c in cols:
        aggs.append(F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"{c}_n"))
    out = df.agg(*aggs)
    if denominator is not None:
        out = out.select("*", *[pct(F.col(f"{c}_n"), F.lit(denominator)).alias(f"{c}_pct") for c in cols])
    return out


def distinct_count(df: DataFrame, col: str, alias: str | None = None) -> DataFrame:
    """distinct non-NULL values of a column (e.g. employers)."""
    return df.agg(F.count_distinct(col).alias(alias or f"n_{col}"))


def row_count(df: DataFrame, alias: str = "n_rows") -> DataFrame:
    """F7."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def cutoff_date(fu: DataFrame, order_col: str | None = None, pattern: str = "dd/MM/yyyy") -> DataFrame:
    """the "data as of" stamp: the cutoff of the first row by
    ``order_col`` (or the earliest stamp), formatted."""
    v = F.min_by("cutoff_date", order_col) if order_col else F.min("cutoff_date")
    return fu.agg(format_date(v, pattern).alias("cutoff_text"))


def change_stats(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """rows whose cell changed, NULL treated as ``''``; one row."""
    return df.agg(*[F.count_if(F.coalesce(F.col(a), F.lit("")) != F.coalesce(F.col(b), F.lit(""))).alias(name)
                    for name, (a, b) in pairs.items()])
