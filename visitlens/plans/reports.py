"""Report compositions (P1-P12).  Each returns a dict of DataFrames.  The counts of
a page come from one scan of the plan and one of the follow-up (``operators.measures``),
made when the page is built; lists of rows (``visit_detail``, ``detail``, ``records``)
are lazy and read their table themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.constants import DETAIL_LABELS, OUTER_SEP, RANKING_TOP, SEGMENT_EXTRA_SEPS, SEGMENT_ORDER
from visitlens.functions.dates import format_date, month_name_es
from visitlens.functions.values import custom_order_key
from visitlens.functions.text import contains_ci
from visitlens.operators import aggregates as A
from visitlens.operators import measures as M
from visitlens.operators.cells import ranked
from visitlens.operators.filters import apply_filters, has_token, only_cases, scheduled
from visitlens.operators.pareto import pareto_concentration, pareto_from_ranking
from visitlens.operators.shape import relabel, row_total, select_existing
from visitlens.session import checkpoint_dir


def visit_detail(prog: DataFrame, sort: bool = False) -> DataFrame:
    """P3 table: formatted date, place, specialist, workers and their total.
    ``sort`` orders by the real date (quirk Q7: not by the day-first text), then centre."""
    out = prog.select(format_date("planned_date", "dd-MM-yyyy").alias("date_text"), "region",
                      "specialist", "employer", "center_name", "commune", "address", "men", "women",
                      row_total("men", "women").alias("total_workers"),
                      F.col("planned_date").alias("__d"))
    if sort:
        out = out.orderBy("__d", "center_name")
    return out.drop("__d")


def visit_table(prog: DataFrame) -> DataFrame:
    """P3 as shown and exported: by real date, under display labels."""
    return relabel(visit_detail(prog, sort=True), DETAIL_LABELS)


def followup_detail(fu: DataFrame) -> DataFrame:
    """P5 table: the follow-up columns that exist, dates as ``dd-MM-yyyy`` or ``''``."""
    cols = ["region", "specialist", "employer", "center_id", "center_name", "address", "commune",
            "visit_status", "goal_met", "pillar_1", "pillar_2", "pillar_3", "pillar_4",
            "prescription_followup_status", "last_professional", "diffusion_date", "training_date",
            "prescription_date", "practical_design_date"]
    df = select_existing(fu, cols)
    return df.select(*[format_date(c, "dd-MM-yyyy", "").alias(c) if c.endswith("_date") else F.col(c)
                       for c in df.columns])


def drill_records(drill: DataFrame) -> DataFrame:
    """P10 record list."""
    return select_existing(drill, ["employer", "center_name", "region", "specialist", "segments",
                                   "occupations", "tasks", "diagnoses", "case_ids", "notes"])


def programme_page(plan: DataFrame, selection: dict, month: int | None = None) -> dict[str, DataFrame]:
    """P1 + P2: monthly load, by region, top specialists/communes, worker totals; P3."""
    prog = scheduled(apply_filters(plan, selection), month)
    counts = [M.rows_where(c, key=c) for c in ("month", "region", "specialist", "commune")]
    m = M.measured(prog, [*counts, M.amount_of("men", "men"), M.amount_of("women", "women")])
    months = M.part(m, "month", "month").select(F.col("month").cast("int").alias("month"), "cnt")
    return {
        "monthly_load": months.select("month", month_name_es("month").alias("month_name"), "cnt").orderBy("month"),
        "by_region": ranked(M.part(m, "region", "region"), name_col="region"),
        "top_specialists": ranked(M.part(m, "specialist", "specialist"), RANKING_TOP, name_col="specialist"),
        "top_communes": ranked(M.part(m, "commune", "commune"), RANKING_TOP, name_col="commune"),
        "worker_totals": M.scalars(m, amounts=["men", "women"]).select(
            (F.col("men") + F.col("women")).cast("bigint").alias("total_workers"),
            F.col("men").cast("bigint").alias("total_men"), F.col("women").cast("bigint").alias("total_women")),
        "visit_detail": visit_table(prog),
    }


def followup_page(plan: DataFrame, fu: DataFrame, selection: dict, month: int | None = None) -> dict[str, DataFrame]:
    """P4 + P5: KPIs, pillar sums, region x goal crosstab, detail."""
    f = apply_filters(fu, selection)
    m = M.measured(apply_filters(plan, selection), A.plan_entries(month))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in f.columns else F.lit(False)
    overdue = F.col("visit_status") == A.OVERDUE_STATUS if "visit_status" in f.columns else F.lit(False)
    entries = [M.rows_where("fu_rows"), M.rows_where("goals", flag("goal_met")), M.rows_where("overdue", overdue),
               *[M.rows_where(p, flag(p)) for p in A.PILLARS],
               M.rows_where("n_true", flag("goal_met"), "region"), M.rows_where("n_false", ~flag("goal_met"), "region")]
    n = M.measured(f, entries)
    counts = M.scalars(n, ["fu_rows", "goals", "overdue", *A.PILLARS])
    cell = lambda name: F.coalesce(F.max(F.when(F.col("measure") == name, F.col("n"))), F.lit(0)).alias(name)
    return {
        "kpi_global": A.kpi_global_of(m, counts),
        "kpi_followup": A.kpi_followup_of(M.scalars(m, ["scheduled"]), counts),
        "region_goal": (n.filter(F.col("measure").isin("n_false", "n_true")).groupBy(F.col("key").alias("region"))
                        .agg(cell("n_false"), cell("n_true"))),
        "detail": followup_detail(f),
    }


def indicators_page(fu: DataFrame, selection: dict) -> dict[str, DataFrame]:
    """P6 + P7: indicators vs the unfiltered team mean, pillar progress."""
    checkpoint_dir(fu.sparkSession)
    counts = A.specialist_counts(fu, selection).checkpoint()
    shown = counts.filter(F.col("centers") > 0)
    ind = A.vs_team_of(counts)
    return {
        "indicators": ind.orderBy(F.col("pct_goal").desc(), "specialist"),   # H5 table
        "indicators_chart": ind.orderBy(F.col("pct_goal").asc(), "specialist"),  # H5 chart
        "team_mean": A.team_mean_of(counts),
        "pillar_long": A.pillar_progress_of(shown),
        "pillar_wide": A.pillar_wide_of(shown),
    }


def _pareto_inner(dimension: str) -> str:
    return " | " if dimension == "occupations" else ","


def _case_entries(dimension: str, chosen) -> list:
    """What P8 and P9 count; ``chosen``: the rows of the segment."""
    return [*A.summary_entries(), M.tokens_of("diagnoses", "diagnoses", [OUTER_SEP, ","]),
            M.distinct_of("employers", "case_ids", "employer", [OUTER_SEP]),
            M.tokens_of("segments", "segments", [OUTER_SEP, ",", *SEGMENT_EXTRA_SEPS]),
            M.tokens_of("dimension", dimension, [OUTER_SEP, _pareto_inner(dimension)], chosen)]


def _segment_options(m: DataFrame) -> DataFrame:
    return M.part(m, "segments").select("name").orderBy(custom_order_key("name", SEGMENT_ORDER), "name")


def _case_tables(m: DataFrame) -> dict[str, DataFrame]:
    p = pareto_from_ranking(M.part(m, "dimension"))
    return {
        "summary": M.scalars(m, ["n_cases", "n_employers", "n_visits"]),
        "top_diagnoses": ranked(M.part(m, "diagnoses"), RANKING_TOP),
        "top_employers": ranked(M.part(m, "employers", "employer", "n_cases"), RANKING_TOP, count_col="n_cases", name_col="employer"),
        "segment_options": _segment_options(m),
        "pareto": p,
        "concentration": pareto_concentration(p),
    }


def case_page(plan: DataFrame, selection: dict, segment: str | None = None,
              dimension: str = "occupations") -> dict[str, DataFrame]:
    """P8 + P9: summary, top diagnoses/employers, Pareto within a segment."""
    chosen = None if segment is None else contains_ci("segments", segment)
    return _case_tables(M.measured(only_cases(apply_filters(plan, selection)), _case_entries(dimension, chosen)))


def _chosen_entries(chosen, prefix: str = "") -> list:
    """What P10 counts in ``chosen``, the rows of the drill-down."""
    return [*A.summary_entries(chosen, prefix), M.distinct_of(f"{prefix}employers", "case_ids", "employer", [OUTER_SEP], chosen),
            M.tokens_of(f"{prefix}occupations", "occupations", [OUTER_SEP, " | "], chosen), M.tokens_of(f"{prefix}tasks", "tasks", [OUTER_SEP, ","], chosen)]


def _drill_entries(chosen) -> list:
    """What P10 counts."""
    return [*_chosen_entries(chosen), M.tokens_of("segments", "segments", [OUTER_SEP, ",", *SEGMENT_EXTRA_SEPS]),
            M.tokens_of("diagnoses", "diagnoses", [OUTER_SEP, ","])]


def _drill_tables(m: DataFrame, drill: DataFrame, prefix: str = "") -> dict[str, DataFrame]:
    summary = M.scalars(m, [f"{prefix}{c}" for c in ("n_cases", "n_employers", "n_visits")])
    return {
        "summary": summary.toDF("n_cases", "n_employers", "n_visits"),
        "employers": M.part(m, f"{prefix}employers", "employer", "n_cases"),
        "occupations": M.part(m, f"{prefix}occupations"),
        "tasks": M.part(m, f"{prefix}tasks"),
        "segment_options": _segment_options(m),
        "diagnosis_options": M.part(m, "diagnoses").select("name").orderBy("name"),
        "records": drill_records(drill),
    }


def drill_page(plan: DataFrame, selection: dict, by: str = "segments", value: str | None = None,
               whole_token: bool = False) -> dict[str, DataFrame]:
    """P10: drill-down by segment or diagnosis.  The value is a substring of the cell
    (Q14) or, with ``whole_token``, one of its tokens.  ``segment_options`` and
    ``diagnosis_options`` are what can be chosen, over all rows with cases."""
    ep = only_cases(apply_filters(plan, selection))
    chosen = None if value is None else has_token(by, value) if whole_token else contains_ci(by, value)
    m = M.measured(ep, _drill_entries(chosen))
    return _drill_tables(m, ep if chosen is None else ep.filter(chosen))


def pareto_drill_page(plan: DataFrame, selection: dict, segment: str | None = None,
                      dimension: str = "occupations") -> dict[str, DataFrame]:
    """Pareto and drill-down on the same segment subset (P9 + P10), counted together."""
    ep = only_cases(apply_filters(plan, selection))
    chosen = None if segment is None else contains_ci("segments", segment)
    m = M.measured(ep, [*_case_entries(dimension, chosen), *_chosen_entries(chosen, "drill_")])
    drill = _drill_tables(m, ep if chosen is None else ep.filter(chosen), "drill_")
    return {f"pareto_{k}": v for k, v in _case_tables(m).items()} | {f"drill_{k}": v for k, v in drill.items()}


def plan_sheet(plan: DataFrame, path: str | None = None) -> DataFrame:
    """The plain plan sheet (existing columns, by real date); written to
    ``path`` when given (A5)."""
    cols = ["planned_date", "region", "specialist", "account", "holding", "employer", "center_name",
            "address", "commune", "men", "women"]
    sheet = select_existing(plan, cols)
    # visits of one date, or of none, come in the order of a hash: no task sorts them all
    sheet = sheet.orderBy("planned_date", F.xxhash64(*[F.col(c) for c in sheet.columns]))
    if path:
        from visitlens.sources.sinks import refresh_table
        refresh_table(sheet, path)
    return sheet
