"""DuckDB SQL per registered query key (see ``oracle_sql`` for the shared CTEs)."""

from __future__ import annotations

from visitlens.constants import OVERDUE_STATUS, PILLAR_HEADERS, SEGMENT_ORDER
from visitlens.functions.values import short_label_text
from visitlens.operators.filters import FACETS
from visitlens.testing import registry as REG
from visitlens.testing.oracle_sql import (MONTHS_LIST, SEG_ORDER_LIST, normalize, pct, q, tokens,
                                          with_base)

EP = "(SELECT * FROM plan WHERE has_case)"
PROG = "(SELECT * FROM plan WHERE planned_date IS NOT NULL)"


def _eq_conds(sel: dict, alias: str = "") -> list[str]:
    a = f"{alias}." if alias else ""
    return [f"{a}{k} = {q(v)}" for k, v in sel.items() if v is not None]


def _where(conds: list[str]) -> str:
    return ("WHERE " + " AND ".join(conds)) if conds else ""


def ranking(src: str, col: str, seps: list[str]) -> str:
    return f"SELECT name, count(*) AS cnt FROM (SELECT unnest({tokens(col, seps)}) AS name FROM {src}) GROUP BY name"


def contains(col: str, text: str) -> str:
    return f"coalesce(contains(upper({col}), upper({q(text)})), false)"


def pareto_sql(src: str, col: str, seps: list[str], top: int = 30, cut: float = 80.0) -> str:
    return f"""
SELECT CAST(row_number() OVER (ORDER BY cnt DESC, name) AS INTEGER) AS rank, name, cnt,
       pct10 / 10 AS pct,
       sum(pct10) OVER (ORDER BY cnt DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 10 AS pct_cum,
       sum(pct10) OVER (ORDER BY cnt DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= {cut * 10} AS vital
FROM (SELECT name, cnt, round_even(cnt / sum(cnt) OVER () * 100 * 10, 0) AS pct10
      FROM ({ranking(src, col, seps)} ORDER BY cnt DESC, name LIMIT {top}))"""


def case_summary_sql(src: str) -> str:
    return f"""
SELECT (SELECT count(DISTINCT c) FROM (SELECT unnest({tokens('case_ids', ['||'])}) AS c FROM {src})) AS n_cases,
       (SELECT count(DISTINCT employer) FROM {src}) AS n_employers,
       (SELECT count(*) FROM {src}) AS n_visits"""


def cases_per_employer_sql(src: str) -> str:
    return f"""
SELECT employer, count(DISTINCT c) AS n_cases
FROM (SELECT employer, unnest({tokens('case_ids', ['||'])}) AS c FROM {src} WHERE employer IS NOT NULL)
GROUP BY employer"""


def value_counts_sql(src: str, col: str, top: int | None = None) -> str:
    s = f"SELECT {col}, count(*) AS cnt FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}"
    if top:
        s += f" ORDER BY cnt DESC, {col} LIMIT {top}"
    return s


def facet_options_sql(sel: dict) -> str:
    parts = []
    for f in FACETS:
        conds = [c for k, c in zip([k for k, v in sel.items() if v is not None], _eq_conds(sel)) if k != f]
        conds.append(f"{f} IS NOT NULL")
        parts.append(f"SELECT DISTINCT {q(f)} AS facet, CAST({f} AS VARCHAR) AS value FROM plan {_where(conds)}")
    return "\nUNION ALL\n".join(parts)


def valid_selection_sql(sel: dict) -> str:
    cols0 = ", ".join(f"CAST({q(sel[f]) if sel.get(f) is not None else 'NULL'} AS VARCHAR) AS {f}" for f in FACETS)
    ctes = [f"s0 AS (SELECT {cols0})"]
    i = 0
    for _ in range(len(FACETS)):
        for f in FACETS:
            i += 1
            others = " AND ".join(f"(s.{g} IS NULL OR p.{g} = s.{g})" for g in FACETS if g != f)
            cond = f"s.{f} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM plan p WHERE p.{f} = s.{f} AND {others})"
            cols = ", ".join(f"CASE WHEN {cond} THEN NULL ELSE s.{g} END AS {g}" if g == f else f"s.{g} AS {g}"
                             for g in FACETS)
            ctes.append(f"s{i} AS (SELECT {cols} FROM s{i - 1} s)")
    body = "\nUNION ALL\n".join(f"SELECT {q(f)} AS facet, {f} AS value FROM s{i}" for f in FACETS)
    return with_base(body, ",\n".join(ctes))


def fu_counts_cte(src: str = "fu") -> str:
    return f"""fc AS (SELECT count(*) AS fu_rows,
       count(*) FILTER (WHERE goal_met) AS goals,
       count(*) FILTER (WHERE visit_status = {q(OVERDUE_STATUS)}) AS overdue,
       count(*) FILTER (WHERE pillar_1) AS p1, count(*) FILTER (WHERE pillar_2) AS p2,
       count(*) FILTER (WHERE pillar_3) AS p3, count(*) FILTER (WHERE pillar_4) AS p4
  FROM {src})"""


def plan_counts_cte(src: str = "plan", month: int | None = None) -> str:
    m = f" AND month = {month}" if month is not None else ""
    return f"""pc AS (SELECT
       (SELECT count(*) FROM {src} WHERE planned_date IS NOT NULL{m}) AS scheduled,
       (SELECT count(DISTINCT c) FROM (SELECT unnest({tokens('case_ids', ['||'])}) AS c FROM {src})) AS n_cases,
       (SELECT count(DISTINCT employer) FROM {src} WHERE has_case) AS emp)"""


def kpi_global_sql(plan_src: str = "plan", fu_src: str = "fu", month: int | None = None) -> str:
    body = f"""
SELECT scheduled,
       CASE WHEN fu_rows > 0 THEN goals END AS goals_met,
       CASE WHEN fu_rows > 0 THEN {pct('goals', 'scheduled')} END AS goal_pct,
       n_cases,
       CAST(CASE WHEN n_cases > 0 THEN emp ELSE 0 END AS BIGINT) AS employers_with_cases
FROM pc, fc"""
    return with_base(body, plan_counts_cte(plan_src, month) + ",\n" + fu_counts_cte(fu_src))


def indicators_cte(name: str, src: str) -> str:
    return f"""{name} AS (SELECT specialist, count(*) AS centers,
       count(*) FILTER (WHERE pillar_1 OR pillar_2 OR pillar_3 OR pillar_4) AS with_any,
       count(*) FILTER (WHERE goal_met) AS goals,
       coalesce(round_even(CAST(count(*) FILTER (WHERE goal_met) AS DOUBLE) / count(*) * 100 * 10, 0), 0.0) AS goal10
  FROM {src} WHERE specialist IS NOT NULL GROUP BY specialist)"""


PILLAR_LABELS = [short_label_text(h) for h in PILLAR_HEADERS]


def _pillar_agg_cte() -> str:
    return """pg AS (SELECT specialist, count(*) AS total,
       count(*) FILTER (WHERE pillar_1) AS p1, count(*) FILTER (WHERE pillar_2) AS p2,
       count(*) FILTER (WHERE pillar_3) AS p3, count(*) FILTER (WHERE pillar_4) AS p4
  FROM fu WHERE specialist IS NOT NULL GROUP BY specialist)"""


def _pillar_wide_sql() -> str:
    cols = ", ".join(
        f"CAST(p{i} AS VARCHAR) || ' (' || CAST({pct(f'p{i}', 'total')} AS VARCHAR) || '%)' AS \"{lab}\""
        for i, lab in enumerate(PILLAR_LABELS, start=1))
    return with_base(f"SELECT specialist, {cols} FROM pg", _pillar_agg_cte())


def atomic_sql(col: str, outer: str, inner: str) -> str:
    items = (f"SELECT unnest(flatten(list_transform(string_split({col}, {q(outer)}), "
             f"lambda x: string_split(x, {q(inner)})))) AS item FROM plan WHERE {col} IS NOT NULL")
    return f"SELECT DISTINCT value FROM (SELECT {normalize('item')} AS value FROM ({items})) WHERE value <> ''"


def build() -> dict[str, str]:
    S = {}
    S["plan_clean"] = with_base("""
SELECT center_id, strftime(planned_date, '%Y-%m-%d') AS planned_date, CAST(month AS VARCHAR) AS month, month_name, region,
       specialist, account, holding, employer, center_name, address, commune, men, women, has_case,
       case_ids, occupations, tasks, diagnoses, segments FROM plan""")
    S["followup_typed"] = with_base("""
SELECT region, specialist, account, holding, employer, center_id, center_name, commune, visit_status,
       goal_met, pillar_1, pillar_2, pillar_3, pillar_4,
       strftime(diffusion_date, '%Y-%m-%d') AS diffusion_date,
       strftime(cutoff_date, '%Y-%m-%d') AS cutoff_date FROM fu""")
    S["month_roundtrip"] = with_base(f"""
SELECT DISTINCT month, month_name, CAST(list_position({MONTHS_LIST}, month_name) AS INTEGER) AS month_back
FROM plan WHERE month IS NOT NULL""")
    S["text_normalized"] = f"SELECT doc_id, {normalize('text')} AS norm_text FROM documents"
    rid = "regexp_extract(url, '/d/([a-zA-Z0-9_-]+)', 1)"
    gid = "coalesce(NULLIF(regexp_extract(url, 'gid=(\\d+)', 1), ''), '0')"
    S["export_url"] = f"""
SELECT page_id, NULLIF({rid}, '') AS sheet_id, {gid} AS gid,
       CASE WHEN coalesce({rid}, '') = '' THEN NULL
            ELSE 'https://docs.google.com/spreadsheets/d/' || {rid} || '/export?format=csv&gid=' || {gid} END AS export_url
FROM (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'https://docs.google.com/spreadsheets/d/p_' || page_id || '-A/edit'
             || CASE WHEN page_id % 2 = 0 THEN '#gid=' || page_id ELSE '' END ELSE url END AS url FROM pages)"""
    S["filtered_plan"] = with_base(f"SELECT center_id, specialist, account, region, employer FROM plan "
                                   f"{_where(_eq_conds(REG.SELECTION))}")
    S["scheduled_month"] = with_base(f"""
SELECT center_id, strftime(planned_date, '%Y-%m-%d') AS planned_date, month FROM plan
WHERE planned_date IS NOT NULL AND month = {REG.MONTH}""")
    S["contains_segment"] = with_base(f"SELECT center_id, segments FROM plan WHERE has_case AND "
                                      f"{contains('segments', REG.SEGMENT_SUBSTRING)}")
    S["facet_options"] = with_base(facet_options_sql(REG.FACET_SELECTION))
    S["valid_selection"] = valid_selection_sql(REG.INVALID_SELECTION)
    S["by_region"] = with_base(value_counts_sql(PROG, "region"))
    S["top_specialists"] = with_base(value_counts_sql(PROG, "specialist", 10))
    S["top_communes"] = with_base(value_counts_sql(PROG, "commune", 10))
    S["monthly_load"] = with_base(f"SELECT month, month_name, count(*) AS cnt FROM {PROG} WHERE month IS NOT NULL "
                                  f"GROUP BY month, month_name")
    S["worker_totals"] = with_base(f"""
SELECT CAST(trunc(coalesce(sum(coalesce(men, 0.0)), 0.0) + coalesce(sum(coalesce(women, 0.0)), 0.0)) AS BIGINT) AS total_workers,
       CAST(trunc(coalesce(sum(coalesce(men, 0.0)), 0.0)) AS BIGINT) AS total_men,
       CAST(trunc(coalesce(sum(coalesce(women, 0.0)), 0.0)) AS BIGINT) AS total_women
FROM {PROG}""")
    S["visit_detail"] = with_base(f"""
SELECT strftime(planned_date, '%d-%m-%Y') AS date_text, region, specialist, employer, center_name, commune,
       address, men, women, coalesce(men, 0.0) + coalesce(women, 0.0) AS total_workers FROM {PROG}""")
    S["followup_detail"] = with_base("""
SELECT region, specialist, employer, center_id, center_name, commune, visit_status, goal_met,
       pillar_1, pillar_2, pillar_3, pillar_4, coalesce(strftime(diffusion_date, '%d-%m-%Y'), '') AS diffusion_date
FROM fu""")
    S["rank_tasks"] = with_base(ranking(EP, "tasks", ["||", ","]))
    S["rank_occupations"] = with_base(ranking(EP, "occupations", ["||", " | "]))
    S["rank_diagnoses"] = with_base(ranking(EP, "diagnoses", ["||", ","]))
    S["rank_segments"] = with_base(f"""
SELECT name, cnt, CAST(coalesce(NULLIF(list_position({SEG_ORDER_LIST}, upper(name)), 0), {len(SEGMENT_ORDER) + 1}) AS INTEGER) AS seg_order
FROM ({ranking(EP, 'segments', ['||', ',', ' '])})""")
    S["distinct_cases"] = with_base(
        f"SELECT count(DISTINCT c) AS n_cases FROM (SELECT unnest({tokens('case_ids', ['||'])}) AS c FROM plan)")
    S["cases_per_employer"] = with_base(cases_per_employer_sql(EP))
    S["case_summary"] = with_base(case_summary_sql(EP))
    S["pareto_tasks"] = with_base(pareto_sql(EP, "tasks", ["||", ","]))
    seg_ep = f"(SELECT * FROM plan WHERE has_case AND {contains('segments', REG.SEGMENT)})"
    S["pareto_occupations_segment"] = with_base(pareto_sql(seg_ep, "occupations", ["||", " | "]))
    S["pareto_concentration"] = with_base(f"""
SELECT count(*) FILTER (WHERE vital) AS n_vital, count(*) AS n_categories,
       {pct('count(*) FILTER (WHERE vital)', 'count(*)')} AS pct_categories,
       CAST(coalesce(sum(cnt) FILTER (WHERE vital), 0) AS BIGINT) AS cases_vital,
       {pct('coalesce(sum(cnt) FILTER (WHERE vital), 0)', 'coalesce(sum(cnt), 0)')} AS pct_cases
FROM ({pareto_sql(EP, 'tasks', ['||', ','])})""")
    drill = f"(SELECT * FROM plan WHERE has_case AND {contains('diagnoses', REG.DIAGNOSIS)})"
    S["drill_employers"] = with_base(cases_per_employer_sql(drill))
    S["drill_occupations"] = with_base(ranking(drill, "occupations", ["||", " | "]))
    S["drill_tasks"] = with_base(ranking(drill, "tasks", ["||", ","]))
    S["drill_summary"] = with_base(case_summary_sql(drill))
    S["drill_records"] = with_base(f"SELECT employer, center_name, region, specialist, segments, occupations, "
                                   f"tasks, diagnoses, case_ids, notes FROM {drill}")
    S["kpi_global"] = kpi_global_sql()
    S["kpi_followup"] = with_base(f"""
SELECT scheduled AS universe, goals, overdue, {pct('goals', 'scheduled')} AS progress_pct,
       p1 AS pillar_1_n, {pct('p1', 'scheduled')} AS pillar_1_pct,
       p2 AS pillar_2_n, {pct('p2', 'scheduled')} AS pillar_2_pct,
       p3 AS pillar_3_n, {pct('p3', 'scheduled')} AS pillar_3_pct,
       p4 AS pillar_4_n, {pct('p4', 'scheduled')} AS pillar_4_pct
FROM pc, fc""", plan_counts_cte() + ",\n" + fu_counts_cte())
    sel_plan = f"(SELECT * FROM plan {_where(_eq_conds(REG.SELECTION))})"
    sel_fu = f"(SELECT * FROM fu {_where(_eq_conds(REG.SELECTION))})"
    S["kpi_month"] = kpi_global_sql(sel_plan, sel_fu, REG.MONTH)
    S["cutoff"] = with_base("SELECT strftime(min_by(cutoff_date, center_id), '%d/%m/%Y') AS cutoff_text FROM fu")
    S["region_goal_crosstab"] = with_base("""
SELECT region, count(*) FILTER (WHERE NOT goal_met) AS n_false, count(*) FILTER (WHERE goal_met) AS n_true
FROM fu WHERE region IS NOT NULL GROUP BY region""")
    S["overdue"] = with_base(f"SELECT count(*) FILTER (WHERE visit_status = {q(OVERDUE_STATUS)}) AS n FROM fu")
    S["specialist_indicators"] = with_base(f"""
SELECT specialist, centers, with_any, {pct('with_any', 'centers')} AS pct_start, goals,
       {pct('goals', 'centers')} AS pct_goal, {pct('goals', 'with_any')} AS efficiency FROM g""",
                                           indicators_cte("g", "fu"))
    team_fu = f"(SELECT * FROM fu {_where(_eq_conds(REG.TEAM_FILTER))})"
    S["specialist_vs_team"] = with_base(f"""
SELECT specialist, centers, with_any, {pct('with_any', 'centers')} AS pct_start, goals,
       {pct('goals', 'centers')} AS pct_goal,
       round_even(goal10 - (SELECT sum(goal10) / count(*) FROM g_all), 0) / 10 AS vs_team_pp,
       {pct('goals', 'with_any')} AS efficiency
FROM g""", indicators_cte("g", team_fu) + ",\n" + indicators_cte("g_all", "fu"))
    long_parts = [f"SELECT specialist, {q(lab)} AS pillar, p{i} AS n, {pct(f'p{i}', 'total')} AS pct FROM pg"
                  for i, lab in enumerate(PILLAR_LABELS, start=1)]
    S["pillar_long"] = with_base("\nUNION ALL\n".join(long_parts), _pillar_agg_cte())
    S["pillar_wide"] = _pillar_wide_sql()
    S["pillar_pivot"] = _pillar_wide_sql()
    S["atomic_tasks"] = with_base(atomic_sql("tasks_dirty", "||", ","))
    S["atomic_occupations"] = with_base(atomic_sql("occupations", "||", "|"))
    return S


# ── normaliser (brute force: every admissible key pair gets an exact LCS) ────
from visitlens.constants import SIMILARITY_THRESHOLD as T  # noqa: E402
from visitlens.testing.oracle_sql import strip  # noqa: E402

LCS_SQL = ("list_reduce(range(1, length({a}) + 1), lambda prev, i: list_reduce(range(1, length({b}) + 1), "
           "lambda acc, j: list_append(acc, CASE WHEN substr({a}, i::INT, 1) = substr({b}, j::INT, 1) "
           "THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[-1]) END), [0::BIGINT]), "
           "list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT))[-1]")


def token_sort_sql(e: str) -> str:
    return (f"array_to_string(list_sort(string_split_regex(trim(regexp_replace(lower({e}), "
            f"'[^\\p{{L}}\\p{{N}}_]', ' ', 'g')), ' +')), ' ')")


def atomic_from(src: str, col: str, outer: str, inner: str) -> str:
    items = (f"SELECT unnest(flatten(list_transform(string_split({col}, {q(outer)}), "
             f"lambda x: string_split(x, {q(inner)})))) AS item FROM {src} WHERE {col} IS NOT NULL")
    return f"SELECT DISTINCT value FROM (SELECT {normalize('item')} AS value FROM ({items})) WHERE value <> ''"


def norm_ctes(p: str, values_sql: str) -> str:
    """CTE chain <p>v, <p>k, <p>ok, <p>sym, <p>canon, <p>near, <p>prop."""
    lcs = LCS_SQL.format(a="a.ts", b="b.ts")
    return f"""
{p}v AS (SELECT value, {token_sort_sql('value')} AS ts FROM ({values_sql})),
{p}k AS (SELECT DISTINCT ts, length(ts) AS n FROM {p}v),
{p}pairs AS (SELECT a.ts AS ta, b.ts AS tb, a.n AS na, b.n AS nb, {lcs} AS lcs
  FROM {p}k a JOIN {p}k b ON a.ts < b.ts AND a.n > 0 AND b.n > 0
   AND least(a.n, b.n) * {200 - T} >= {T} * greatest(a.n, b.n)),
{p}ok AS (SELECT * FROM {p}pairs WHERE 200 * lcs >= {T} * (na + nb)),
{p}sym AS (SELECT ta AS x, tb AS y, CAST(200 AS DOUBLE) * lcs / (na + nb) AS score FROM {p}ok
  UNION ALL SELECT tb, ta, CAST(200 AS DOUBLE) * lcs / (na + nb) FROM {p}ok
  UNION ALL SELECT ts, ts, CAST(100 AS DOUBLE) FROM {p}k),
{p}best AS (SELECT ts, arg_max(value, {{'l': length(value), 's': value}}) AS best FROM {p}v GROUP BY ts),
{p}rep AS (SELECT s.x, arg_max(b.best, {{'l': length(b.best), 's': b.best}}) AS rep
  FROM {p}sym s JOIN {p}best b ON s.y = b.ts GROUP BY s.x),
{p}canon AS (SELECT DISTINCT r.rep AS canonical FROM {p}v JOIN {p}rep r ON {p}v.ts = r.x),
{p}mc AS (SELECT v.ts, min(c.canonical) AS mc FROM {p}canon c JOIN {p}v v ON v.value = c.canonical GROUP BY v.ts),
{p}near AS (SELECT x, mc, score FROM (SELECT s.x, m.mc, s.score,
    row_number() OVER (PARTITION BY s.x ORDER BY s.score DESC, m.mc) AS rn
  FROM {p}sym s JOIN {p}mc m ON s.y = m.ts) WHERE rn = 1),
{p}prop AS (SELECT v.value AS variante, n.mc AS canonical_propuesto,
    CAST(round_even(n.score, 0) AS INTEGER) AS similitud
  FROM {p}v v JOIN {p}near n ON v.ts = n.x
  WHERE v.value NOT IN (SELECT canonical FROM {p}canon) AND n.score >= {T})"""


RAW_DIRTY = "(SELECT center_id, occupations_dirty AS ocupaciones, tasks_dirty AS tareas FROM plan_raw)"


def _rewrite(cell: str, m: str, outer: str, inner: str) -> str:
    key = normalize("it")
    item = f"CASE WHEN {strip('it')} = '' THEN '' ELSE upper(coalesce(map_extract({m}, {key})[1], {key})) END"
    parts = (f"list_transform(string_split({cell}, {q(outer)}), lambda p: array_to_string("
             f"list_transform(string_split(p, {q(inner)}), lambda it: {item}), {q(inner)}))")
    return f"CASE WHEN {cell} IS NULL OR {strip(cell)} = '' THEN {cell} ELSE array_to_string({parts}, {q(outer)}) END"


def _canon_ctes() -> str:
    t = norm_ctes("t", atomic_from(RAW_DIRTY, "tareas", "||", ","))
    o = norm_ctes("o", atomic_from(RAW_DIRTY, "ocupaciones", "||", "|"))
    maps = f"""
omap AS (SELECT map_from_entries(list({{'k': {strip('variante')}, 'v': {strip('canonical_propuesto')}}})) AS m FROM oprop),
tmap AS (SELECT map_from_entries(list({{'k': {strip('variante')}, 'v': {strip('canonical_propuesto')}}})) AS m FROM tprop),
canon_rows AS (SELECT r.center_id, r.ocupaciones AS occ_before, r.tareas AS tasks_before,
    {_rewrite('r.ocupaciones', 'omap.m', '||', '||')} AS occupations,
    {_rewrite('r.tareas', 'tmap.m', '||', ',')} AS tasks
  FROM {RAW_DIRTY} r, omap, tmap)"""
    return t + ",\n" + o + ",\n" + maps


def build_extra() -> dict[str, str]:
    S = {}
    t_ctes = norm_ctes("t", atomic_from(RAW_DIRTY, "tareas", "||", ","))
    S["similar_pairs"] = with_base("""
SELECT least(ta, tb) AS key_a, greatest(ta, tb) AS key_b, CAST(lcs AS INTEGER) AS lcs,
       CAST(round_even(CAST(200 AS DOUBLE) * lcs / (na + nb), 0) AS INTEGER) AS similarity FROM tok""", t_ctes)
    S["canonical_proposals"] = with_base("SELECT * FROM tprop", t_ctes)
    o_ctes = norm_ctes("o", atomic_from(RAW_DIRTY, "ocupaciones", "||", "|"))
    S["occupation_proposals"] = with_base("SELECT * FROM oprop", o_ctes)
    stats = []
    for p, name in [("o", "ocupaciones"), ("t", "tareas")]:
        stats.append(f"""SELECT {q(name)} AS column, (SELECT count(*) FROM {p}v) AS n_values,
       (SELECT count(*) FROM {p}canon) AS n_clusters,
       (SELECT count(*) FROM {p}v) - (SELECT count(*) FROM {p}canon) AS n_variants,
       (SELECT count(*) FROM {p}prop) AS n_proposals""")
    S["cluster_stats"] = with_base("\nUNION ALL\n".join(stats), t_ctes + ",\n" + o_ctes)
    S["canonicalized"] = with_base("SELECT center_id, occupations, tasks FROM canon_rows", _canon_ctes())
    S["change_stats"] = with_base("""
SELECT count(*) FILTER (WHERE coalesce(occupations, '') <> coalesce(occ_before, '')) AS changed_ocupaciones,
       count(*) FILTER (WHERE coalesce(tasks, '') <> coalesce(tasks_before, '')) AS changed_tareas
FROM canon_rows""", _canon_ctes())
    S["payload_rows"] = """
SELECT user_id AS batch_user, CAST(floor(event_id / 64) AS BIGINT) AS chunk,
       CAST(row_number() OVER (PARTITION BY user_id, floor(event_id / 64) ORDER BY event_id) - 1 AS INTEGER) AS row_no,
       CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, props
FROM events"""
    S["payload_ack"] = """
SELECT user_id AS batch_user, CAST(floor(event_id / 64) AS BIGINT) AS chunk,
       '{"success":true,"rows_written":' || CAST(count(*) AS VARCHAR) || '}' AS ack
FROM events GROUP BY user_id, floor(event_id / 64)"""
    S["sink_refresh"] = build()["followup_detail"]
    S["sink_append"] = with_base(f"""
SELECT strftime(planned_date, '%d-%m-%Y') AS date_text, region, specialist, employer, center_name, commune,
       address, CAST(men AS VARCHAR) AS men, CAST(women AS VARCHAR) AS women,
       CAST(coalesce(men, 0.0) + coalesce(women, 0.0) AS VARCHAR) AS total_workers FROM {PROG}""")
    base = build()
    S["plan_csv_roundtrip"] = base["plan_clean"]
    S["followup_csv_roundtrip"] = base["followup_typed"]
    S["sql_view"] = base["by_region"]
    S["canonical_lookup"] = with_base(
        "SELECT v.value, coalesce(p.canonical_propuesto, v.value) AS canonical "
        "FROM tv v LEFT JOIN tprop p ON v.value = p.variante", t_ctes)
    S["table_info"] = with_base("""
SELECT count(*) AS rows, coalesce(NULLIF(CAST(min_by(region, center_id) AS VARCHAR), ''), 'sin datos') AS updated
FROM fu""")
    return S
