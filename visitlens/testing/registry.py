"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Inputs are the driver's tables through ``adapter`` (raw rows only); every
step named by a query runs through the library's operators on the whole
tables.  Column names equal those of the matching SQL in ``oracle_queries``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.constants import SEGMENT_EXTRA_SEPS, SEGMENT_ORDER
from visitlens.functions.dates import format_date, month_number_es
from visitlens.functions.text import normalize_text
from visitlens.functions.values import custom_order_key, export_url, sheet_gid, sheet_id
from visitlens.operators import aggregates as A
from visitlens.operators.cells import (atomic_values, cases_per_group, count_distinct_cases,
                                       multi_value_ranking)
from visitlens.operators.clean import clean_plan, type_followup
from visitlens.operators.filters import (apply_filters, contains_filter, facet_options, only_cases,
                                         scheduled, selection_frame, validate_selection)
from visitlens.operators.pareto import pareto, pareto_concentration
from visitlens.plans import reports as R
from visitlens.testing.adapter import followup_raw, plan_raw, table
from visitlens.operators.similarity_join import cluster
from visitlens.plans.normalizer import (phase1_proposals, phase1_stats, phase2_apply,
                                        phase2_changes, vocabulary, PHASE1_SEPS)
from visitlens.session import checkpoint_dir, scratch_path
from visitlens.sources.payload import build_payload, payload_to_rows, result_envelope
from visitlens.sources.sinks import append_rows, init_table, refresh_table, table_info
from visitlens.operators.lookup import lookup
from visitlens.sources.readers import read_followup, read_plan, register, sql

# Fixed parameters of the registered queries (a user's dashboard selections).
SELECTION = {"specialist": "ERG-5", "account": "MACHINERY", "holding": None, "employer": None,
             "region": None}
FACET_SELECTION = {"specialist": "ERG-5", "account": "MACHINERY", "holding": None, "employer": None,
                   "region": "3"}
INVALID_SELECTION = {"specialist": "ERG-5", "account": "MACHINERY", "holding": "NATION_3",
                     "employer": None, "region": "7"}
MONTH = 3
SEGMENT = "MANO_DER"
SEGMENT_SUBSTRING = "mano"
DIAGNOSIS = "Brand#1"
TEAM_FILTER = {"account": "MACHINERY"}


def plan(spark: SparkSession, d: str, dirty_tasks: bool = False) -> DataFrame:
    from visitlens.testing.adapter import _memo
    return _memo(spark, ("plan", d, dirty_tasks), lambda: clean_plan(plan_raw(spark, d, dirty_tasks=dirty_tasks)))


def followup(spark: SparkSession, d: str) -> DataFrame:
    from visitlens.testing.adapter import _memo
    return _memo(spark, ("followup", d), lambda: type_followup(followup_raw(spark, d)))


def _iso(c: str):
    return format_date(c, "yyyy-MM-dd").alias(c)


def q_plan_clean(spark, d):
    p = plan(spark, d)
    # month as text: a nullable integer column converts differently per client library
    return p.select("center_id", _iso("planned_date"), F.col("month").cast("string").alias("month"),
                    "month_name", "region", "specialist",
                    "account", "holding", "employer", "center_name", "address", "commune", "men",
                    "women", "has_case", "case_ids", "occupations", "tasks", "diagnoses", "segments")


def q_followup_typed(spark, d):
    f = followup(spark, d)
    return f.select("region", "specialist", "account", "holding", "employer", "center_id",
                    "center_name", "commune", "visit_status", "goal_met", "pillar_1", "pillar_2",
                    "pillar_3", "pillar_4", _iso("diffusion_date"), _iso("cutoff_date"))


def q_month_roundtrip(spark, d):
    p = plan(spark, d).filter(F.col("month").isNotNull())
    return p.select("month", "month_name", month_number_es("month_name").alias("month_back")).distinct()


def q_text_normalized(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", normalize_text("text").alias("norm_text"))


def q_export_url(spark, d):
    # two of three pages stand for a spreadsheet link, every other of them with a sheet
    k = F.col("page_id")
    link = F.concat(F.lit("https://docs.google.com/spreadsheets/d/p_"), k.cast("string"), F.lit("-A/edit"),
                    F.when(k % 2 == 0, F.concat(F.lit("#gid="), k.cast("string"))).otherwise(F.lit("")))
    pages = table(spark, d, "pages").select("page_id", F.when(k % 3 != 0, link).otherwise(F.col("url")).alias("url"))
    return pages.select("page_id", sheet_id("url").alias("sheet_id"), sheet_gid("url").alias("gid"),
                        export_url("url").alias("export_url"))


def q_filtered_plan(spark, d):
    return apply_filters(plan(spark, d), SELECTION).select("center_id", "specialist", "account", "region",
                                                           "employer")


def q_scheduled_month(spark, d):
    return scheduled(plan(spark, d), MONTH).select("center_id", _iso("planned_date"), "month")


def q_contains_segment(spark, d):
    return contains_filter(only_cases(plan(spark, d)), "segments", SEGMENT_SUBSTRING) \
        .select("center_id", "segments")


def q_facet_options(spark, d):
    return facet_options(plan(spark, d), FACET_SELECTION)


def q_valid_selection(spark, d):
    sel = validate_selection(plan(spark, d), INVALID_SELECTION)
    return selection_frame(spark, sel)


def _prog(spark, d):
    return scheduled(plan(spark, d))


def q_by_region(spark, d):
    return A.value_counts(_prog(spark, d), "region")


def q_top_specialists(spark, d):
    return A.value_counts(_prog(spark, d), "specialist", top=10)


def q_top_communes(spark, d):
    return A.value_counts(_prog(spark, d), "commune", top=10)


def q_monthly_load(spark, d):
    return A.monthly_load(_prog(spark, d))


def q_worker_totals(spark, d):
    return A.worker_totals(_prog(spark, d))


def q_visit_detail(spark, d):
    return R.visit_detail(_prog(spark, d))


def q_followup_detail(spark, d):
    return R.followup_detail(followup(spark, d))


def _ep(spark, d):
    return only_cases(plan(spark, d))


def q_rank_tasks(spark, d):
    return multi_value_ranking(_ep(spark, d), "tasks", ",")


def q_rank_occupations(spark, d):
    return multi_value_ranking(_ep(spark, d), "occupations", " | ")


def q_rank_diagnoses(spark, d):
    return multi_value_ranking(_ep(spark, d), "diagnoses", ",")


def q_rank_segments(spark, d):
    r = multi_value_ranking(_ep(spark, d), "segments", ",", extra=SEGMENT_EXTRA_SEPS)
    return r.withColumn("seg_order", custom_order_key("name", SEGMENT_ORDER))


def q_distinct_cases(spark, d):
    return count_distinct_cases(plan(spark, d))


def q_cases_per_employer(spark, d):
    return cases_per_group(_ep(spark, d), "employer")


def q_case_summary(spark, d):
    return A.case_summary(_ep(spark, d))


def q_pareto_tasks(spark, d):
    return pareto(_ep(spark, d), "tasks", ",")


def q_pareto_occupations_segment(spark, d):
    return pareto(contains_filter(_ep(spark, d), "segments", SEGMENT), "occupations", " | ")


def q_pareto_concentration(spark, d):
    return pareto_concentration(pareto(_ep(spark, d), "tasks", ","))


def _drill(spark, d):
    return contains_filter(_ep(spark, d), "diagnoses", DIAGNOSIS)


def q_drill_employers(spark, d):
    return cases_per_group(_drill(spark, d), "employer")


def q_drill_occupations(spark, d):
    return multi_value_ranking(_drill(spark, d), "occupations", " | ")


def q_drill_tasks(spark, d):
    return multi_value_ranking(_drill(spark, d), "tasks", ",")


def q_drill_summary(spark, d):
    return A.case_summary(_drill(spark, d))


def q_drill_records(spark, d):
    return R.drill_records(_drill(spark, d))


def q_kpi_global(spark, d):
    return A.kpi_global(plan(spark, d), followup(spark, d))


def q_kpi_followup(spark, d):
    return A.kpi_followup(plan(spark, d), followup(spark, d))


def q_kpi_month(spark, d):
    p = apply_filters(plan(spark, d), SELECTION)
    f = apply_filters(followup(spark, d), SELECTION)
    return A.kpi_global(p, f, month=MONTH)


def q_cutoff(spark, d):
    return A.cutoff_date(followup(spark, d), order_col="center_id")


def q_region_goal_crosstab(spark, d):
    return A.crosstab_flag(followup(spark, d), "region", "goal_met")


def q_overdue(spark, d):
    return A.status_count(followup(spark, d))


def q_specialist_indicators(spark, d):
    return A.specialist_indicators(followup(spark, d)).drop("goal10")


def q_specialist_vs_team(spark, d):
    return A.specialist_vs_team_selection(followup(spark, d), TEAM_FILTER)


def q_pillar_long(spark, d):
    return A.pillar_progress(followup(spark, d))


def q_pillar_wide(spark, d):
    return A.pillar_wide(followup(spark, d))


def q_pillar_pivot(spark, d):
    return A.pivot_pillars(A.pillar_progress(followup(spark, d)))


def q_atomic_tasks(spark, d):
    return atomic_values(plan(spark, d, dirty_tasks=True), "tasks", "||", ",")


def q_atomic_occupations(spark, d):
    return atomic_values(plan(spark, d), "occupations", "||", "|")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "plan_clean": q_plan_clean,
    "followup_typed": q_followup_typed,
    "month_roundtrip": q_month_roundtrip,
    "text_normalized": q_text_normalized,
    "export_url": q_export_url,
    "filtered_plan": q_filtered_plan,
    "scheduled_month": q_scheduled_month,
    "contains_segment": q_contains_segment,
    "facet_options": q_facet_options,
    "valid_selection": q_valid_selection,
    "by_region": q_by_region,
    "top_specialists": q_top_specialists,
    "top_communes": q_top_communes,
    "monthly_load": q_monthly_load,
    "worker_totals": q_worker_totals,
    "visit_detail": q_visit_detail,
    "followup_detail": q_followup_detail,
    "rank_tasks": q_rank_tasks,
    "rank_occupations": q_rank_occupations,
    "rank_diagnoses": q_rank_diagnoses,
    "rank_segments": q_rank_segments,
    "distinct_cases": q_distinct_cases,
    "cases_per_employer": q_cases_per_employer,
    "case_summary": q_case_summary,
    "pareto_tasks": q_pareto_tasks,
    "pareto_occupations_segment": q_pareto_occupations_segment,
    "pareto_concentration": q_pareto_concentration,
    "drill_employers": q_drill_employers,
    "drill_occupations": q_drill_occupations,
    "drill_tasks": q_drill_tasks,
    "drill_summary": q_drill_summary,
    "drill_records": q_drill_records,
    "kpi_global": q_kpi_global,
    "kpi_followup": q_kpi_followup,
    "kpi_month": q_kpi_month,
    "cutoff": q_cutoff,
    "region_goal_crosstab": q_region_goal_crosstab,
    "overdue": q_overdue,
    "specialist_indicators": q_specialist_indicators,
    "specialist_vs_team": q_specialist_vs_team,
    "pillar_long": q_pillar_long,
    "pillar_wide": q_pillar_wide,
    "pillar_pivot": q_pillar_pivot,
    "atomic_tasks": q_atomic_tasks,
    "atomic_occupations": q_atomic_occupations,
}


# ── normaliser ──────────────────────────────────────────────────────────────


def _raw_dirty(spark, d):
    return plan_raw(spark, d, dirty_tasks=True)


def q_similar_pairs(spark, d):
    vocab = vocabulary(_raw_dirty(spark, d), {"tareas": PHASE1_SEPS["tareas"]})
    pairs = cluster(vocab)["pairs"]
    return pairs.select(F.least("ts_a", "ts_b").alias("key_a"), F.greatest("ts_a", "ts_b").alias("key_b"),
                        F.col("lcs").cast("int").alias("lcs"), F.rint("score").cast("int").alias("similarity"))


def q_canonical_proposals(spark, d):
    return phase1_proposals(_raw_dirty(spark, d), seps={"tareas": PHASE1_SEPS["tareas"]})["tareas"]


def q_occupation_proposals(spark, d):
    return phase1_proposals(_raw_dirty(spark, d), seps={"ocupaciones": PHASE1_SEPS["ocupaciones"]})["ocupaciones"]


def q_cluster_stats(spark, d):
    return phase1_stats(_raw_dirty(spark, d))


def _pinned(spark, d, *columns):
    """Columns of the raw plan in the checkpoint folder: built once for the vocabulary,
    the dictionary of cells and the rewriting, which all read them."""
    checkpoint_dir(spark)
    return _raw_dirty(spark, d).select(*columns).checkpoint()


def q_canonicalized(spark, d):
    raw = _pinned(spark, d, "ID-CT", "ocupaciones", "tareas")
    out = phase2_apply(raw, phase1_proposals(raw))
    return out.select(F.col("ID-CT").alias("center_id"), F.col("ocupaciones").alias("occupations"),
                      F.col("tareas").alias("tasks"))


def q_change_stats(spark, d):
    raw = _pinned(spark, d, "ocupaciones", "tareas")
    out = phase2_apply(raw, phase1_proposals(raw), keep_original=True)
    return phase2_changes(out, ["ocupaciones", "tareas"])


# ── payloads and sinks ──────────────────────────────────────────────────────

PAYLOAD_COLUMNS = ["event_id", "user_id", "event_type", "props"]
PAYLOAD_CHUNK = 64


def _payloads(spark, d):
    return build_payload(table(spark, d, "events"), ["user_id"], PAYLOAD_COLUMNS, "event_id",
                         chunk_rows=PAYLOAD_CHUNK)


def q_payload_rows(spark, d):
    p = _payloads(spark, d).withColumnRenamed("user_id", "batch_user")
    return payload_to_rows(p, PAYLOAD_COLUMNS, keep=["batch_user", "chunk"])


def q_payload_ack(spark, d):
    rows = payload_to_rows(_payloads(spark, d), PAYLOAD_COLUMNS, keep=["chunk"])
    counts = rows.groupBy(F.col("user_id").cast("bigint").alias("batch_user"), "chunk").agg(F.count(F.lit(1)).alias("rows_written"))
    return counts.select("batch_user", "chunk", result_envelope("rows_written").alias("ack"))


def q_sink_refresh(spark, d):
    path = scratch_path(spark, "followup_detail")
    refresh_table(R.followup_detail(followup(spark, d)), path)
    return spark.read.parquet(path)


def q_sink_append(spark, d):
    # the detail is written once, the two appends read that table
    path, staged = scratch_path(spark, "visit_detail"), scratch_path(spark, "visit_detail_staged")
    refresh_table(R.visit_detail(_prog(spark, d)), staged)
    detail = spark.read.parquet(staged)
    init_table(spark, detail.columns, path)
    append_rows(detail.filter(F.col("date_text").substr(4, 2) <= "06"), path)
    append_rows(detail.filter(~(F.col("date_text").substr(4, 2) <= "06")), path)
    return spark.read.parquet(path)


def q_table_info(spark, d):
    path = scratch_path(spark, "followup_info")
    refresh_table(R.followup_detail(followup(spark, d)), path)
    return table_info(spark.read.parquet(path), "center_id")


QUERIES.update({
    "similar_pairs": q_similar_pairs,
    "canonical_proposals": q_canonical_proposals,
    "occupation_proposals": q_occupation_proposals,
    "cluster_stats": q_cluster_stats,
    "canonicalized": q_canonicalized,
    "change_stats": q_change_stats,
    "payload_rows": q_payload_rows,
    "payload_ack": q_payload_ack,
    "sink_refresh": q_sink_refresh,
    "sink_append": q_sink_append,
    "table_info": q_table_info,
})


# ── sources through real files, SQL views, dictionary lookups ─────────────

CSV_WRITE = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _as_csv(spark, df, name):
    path = scratch_path(spark, name)
    df.write.options(**CSV_WRITE).mode("overwrite").csv(path)
    return path


def q_plan_csv_roundtrip(spark, d):
    """A1: the raw plan sheet written as CSV, scanned all-STRING and typed."""
    raw = plan_raw(spark, d).withColumns({  # missing cells as exports spell them
        "Ergonomo": F.coalesce("Ergonomo", F.lit("NA")), "Holding": F.coalesce("Holding", F.lit("N/A")),
        "Region": F.coalesce("Region", F.lit("NULL"))})
    p = read_plan(spark, _as_csv(spark, raw, "plan_csv"))
    return p.select("center_id", _iso("planned_date"), F.col("month").cast("string").alias("month"),
                    "month_name", "region", "specialist", "account", "holding", "employer", "center_name",
                    "address", "commune", "men", "women", "has_case", "case_ids", "occupations", "tasks",
                    "diagnoses", "segments")


def q_followup_csv_roundtrip(spark, d):
    """A2: the raw follow-up sheet written as CSV, scanned all-STRING and typed."""
    raw = followup_raw(spark, d).withColumns({"Ergonomo": F.coalesce("Ergonomo", F.lit("nan")),
                                              "Holding": F.coalesce("Holding", F.lit("<NA>"))})
    f = read_followup(spark, _as_csv(spark, raw, "followup_csv"))
    return f.select("region", "specialist", "account", "holding", "employer", "center_id",
                    "center_name", "commune", "visit_status", "goal_met", "pillar_1", "pillar_2",
                    "pillar_3", "pillar_4", _iso("diffusion_date"), _iso("cutoff_date"))


def q_sql_view(spark, d):
    """The typed plan registered as a view and queried with SQL."""
    register(plan(spark, d), "visit_plan")
    return sql(spark, "SELECT region, count(*) AS cnt FROM visit_plan "
                      "WHERE planned_date IS NOT NULL GROUP BY region")


def q_canonical_lookup(spark, d):
    """Every task label mapped through the proposals (missing -> itself)."""
    vocab = vocabulary(_raw_dirty(spark, d), {"tareas": PHASE1_SEPS["tareas"]})
    props = cluster(vocab)["proposals"]
    return lookup(vocab.select("value"), "value", props, "variant", "canonical", out="canonical")


QUERIES.update({
    "plan_csv_roundtrip": q_plan_csv_roundtrip,
    "followup_csv_roundtrip": q_followup_csv_roundtrip,
    "sql_view": q_sql_view,
    "canonical_lookup": q_canonical_lookup,
})
