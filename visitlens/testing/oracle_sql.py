"""Independent DuckDB SQL for every registered query.

Written against the driver's pre-registered views (orders, customer, nation,
lineitem, part, pages, documents, events).  The first CTEs rebuild the same
raw rows as ``adapter.py``; the rest re-derives each result in plain SQL —
no code is shared with the Spark implementation except the fixed constants.
"""

from __future__ import annotations

from visitlens import constants as K
from visitlens.testing.adapter import FIXTURE_SEGMENTS

WS = K.WHITESPACE_CLASS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def normalize(e: str) -> str:
    t = f"lower({strip(e)})"
    t = f"regexp_replace(translate({t}, {q(K.ACCENT_SRC)}, {q(K.ACCENT_DST)}), '\\p{{Mn}}', '', 'g')"
    t = f"regexp_replace({t}, '{WS}+', ' ', 'g')"
    t = f"regexp_replace({t}, '[^{K.NORMALIZE_KEEP_CLASS}]', '', 'g')"
    return f"trim({t})"


def r1(e: str) -> str:
    """Half-even rounding to one decimal on ``e*10``."""
    return f"(round_even(({e}) * 10, 0) / 10)"


def pct(n: str, d: str) -> str:
    return f"coalesce(CASE WHEN ({d}) = 0 THEN NULL ELSE {r1(f'CAST({n} AS DOUBLE) / ({d}) * 100')} END, 0.0)"


def tokens(cell: str, seps: list[str]) -> str:
    """List of stripped non-blank tokens of a nested cell."""
    arr = f"list_transform(string_split({cell}, {q(seps[0])}), lambda x0: {strip('x0')})"
    for i, sep in enumerate(seps[1:], start=1):
        v = f"x{i}"
        arr = f"flatten(list_transform({arr}, lambda {v}: list_transform(string_split({v}, {q(sep)}), lambda y{i}: {strip(f'y{i}')})))"
    return f"list_filter(coalesce({arr}, []), lambda t: t <> '')"


SEG_LIST = "[" + ", ".join(q(s) for s in FIXTURE_SEGMENTS) + "]"
SEG_ORDER_LIST = "[" + ", ".join(q(s) for s in K.SEGMENT_ORDER) + "]"
MONTHS_LIST = "[" + ", ".join(q(m) for m in K.MONTH_NAMES_ES) + "]"

DATE_FMTS = ["%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%y", "%d/%m/%y", "%m/%d/%y",
             "%d.%m.%Y", "%m.%d.%Y", "%Y%m%d", "%d-%m-%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S",
             "%Y/%m/%d", "%Y-%m-%d %H:%M:%S"]


def parse_date(e: str) -> str:
    s = strip(e)
    return "CAST(coalesce(" + ", ".join(f"try_strptime({s}, {q(f)})" for f in DATE_FMTS) + ") AS DATE)"


def parse_bool(e: str) -> str:
    return f"coalesce(upper({strip(e)}) IN ('TRUE', '1', 'VERDADERO'), false)"


BASE_CTES = f"""
cells_line AS (
  SELECT l_orderkey,
         'F' || CAST(l_orderkey % 500 AS VARCHAR) || '-' || CAST(l_suppkey % 3 AS VARCHAR) AS folio,
         upper(p_type) || ' ' || upper(split_part(p_name, ' ', 2)) AS occ,
         CASE p_partkey % 5 WHEN 0 THEN lower(p_type || ' ' || split_part(p_name, ' ', 2)) || 's'
                            WHEN 1 THEN upper(split_part(p_name, ' ', 2)) || ' ' || upper(p_type)
                            WHEN 2 THEN upper(p_type || ' ' || split_part(p_name, ' ', 2)) || ' A'
                            ELSE upper(p_type || ' ' || split_part(p_name, ' ', 2)) END AS occ_dirty,
         p_name AS task,
         CASE p_partkey % 5 WHEN 0 THEN p_name
                            WHEN 1 THEN upper(p_name) || 'S'
                            WHEN 2 THEN translate(p_name, 'aeo', 'áéó')
                            WHEN 3 THEN '  ' || replace(p_name, ' ', '   ') || ' '
                            ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS task_dirty,
         p_brand AS diag,
         {SEG_LIST}[CAST(l_partkey % 6 AS INTEGER) + 1] AS seg
  FROM lineitem JOIN part ON l_partkey = p_partkey),
cells_case AS (
  SELECT l_orderkey, folio,
         string_agg(occ, ' | ' ORDER BY occ) AS occ, string_agg(occ_dirty, ' | ' ORDER BY occ_dirty) AS occ_dirty, string_agg(task, ', ' ORDER BY task) AS task,
         string_agg(task_dirty, ', ' ORDER BY task_dirty) AS task_dirty,
         string_agg(diag, ', ' ORDER BY diag) AS diag, string_agg(seg, ' ' ORDER BY seg) AS seg
  FROM cells_line GROUP BY l_orderkey, folio),
cells AS (
  SELECT l_orderkey,
         string_agg(folio, ' || ' ORDER BY folio) AS case_ids,
         string_agg(occ, ' || ' ORDER BY occ) AS occupations,
         string_agg(occ_dirty, ' || ' ORDER BY occ_dirty) AS occupations_dirty,
         string_agg(task, ' || ' ORDER BY task) AS tasks,
         string_agg(task_dirty, ' || ' ORDER BY task_dirty) AS tasks_dirty,
         string_agg(diag, ' || ' ORDER BY diag) AS diagnoses,
         string_agg(seg, ' || ' ORDER BY seg) AS segments
  FROM cells_case WHERE l_orderkey % 5 <> 0 GROUP BY l_orderkey),
base AS (
  SELECT o_orderkey, o_custkey, o_orderdate, c_name, c_mktsegment, n_name
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey),
plan_raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS center_id,
         CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'por definir'
              WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y')
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS planned_raw,
         CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(o_custkey % 16 AS VARCHAR) || '.0' END AS region_raw,
         CASE WHEN o_custkey % 29 = 0 THEN NULL ELSE 'ERG-' || CAST(o_custkey % 23 AS VARCHAR) END AS specialist_raw,
         c_mktsegment AS account_raw,
         CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE n_name END AS holding_raw,
         c_name AS employer,
         'CT-' || CAST(o_orderkey AS VARCHAR) AS center_name,
         CASE WHEN o_custkey % 6 = 0 THEN 'Calle "' || CAST(o_custkey AS VARCHAR) || '", piso' || chr(10) || '2'
              ELSE 'Calle ' || CAST(o_custkey AS VARCHAR) END AS address,
         n_name AS commune_raw,
         CAST(CAST(o_orderkey % 40 AS DOUBLE) AS VARCHAR) AS men_raw,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(CAST(o_orderkey % 25 AS DOUBLE) AS VARCHAR) END AS women_raw,
         case_ids, occupations, occupations_dirty, tasks, tasks_dirty, diagnoses, segments
  FROM base LEFT JOIN cells ON o_orderkey = l_orderkey),
plan AS (
  SELECT center_id,
         {parse_date('planned_raw')} AS planned_date,
         CAST(month({parse_date('planned_raw')}) AS INTEGER) AS month,
         {MONTHS_LIST}[month({parse_date('planned_raw')})] AS month_name,
         replace(coalesce(region_raw, 'S/R'), '.0', '') AS region,
         coalesce(specialist_raw, 'No Asignado') AS specialist,
         coalesce(account_raw, 'Sin Dato') AS account,
         coalesce(holding_raw, 'Sin Dato') AS holding,
         employer, center_name, address,
         coalesce(commune_raw, 'S/D') AS commune,
         TRY_CAST(men_raw AS DOUBLE) AS men, TRY_CAST(women_raw AS DOUBLE) AS women,
         coalesce({strip("coalesce(case_ids, '')")} <> '', false) AS has_case,
         coalesce(case_ids, '') AS case_ids, coalesce(occupations, '') AS occupations,
         coalesce(tasks, '') AS tasks, coalesce(diagnoses, '') AS diagnoses,
         coalesce(segments, '') AS segments,
         '' AS icd10, '' AS notes,
         tasks_dirty
  FROM plan_raw),
fu_raw AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(o_custkey % 16 AS VARCHAR) || '.0' END AS region_raw,
         CASE WHEN o_custkey % 29 = 0 THEN NULL ELSE 'ERG-' || CAST(o_custkey % 23 AS VARCHAR) END AS specialist,
         c_mktsegment AS account,
         CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE n_name END AS holding,
         c_name AS employer,
         CAST(o_orderkey AS VARCHAR) AS center_id,
         'CT-' || CAST(o_orderkey AS VARCHAR) AS center_name,
         n_name AS commune,
         CASE o_orderkey % 5 WHEN 0 THEN 'Pendiente atrasada' WHEN 1 THEN 'Pendiente' ELSE 'Realizada' END AS visit_status,
         CASE WHEN (o_orderkey + 1 * o_custkey) % 7 < 3 AND (o_orderkey + 2 * o_custkey) % 7 < 3
               AND (o_orderkey + 3 * o_custkey) % 7 < 3 AND (o_orderkey + 4 * o_custkey) % 7 < 3
               AND o_orderkey % 3 > 0 THEN 'TRUE' ELSE 'FALSE' END AS goal_raw,
         ['TRUE', 'verdadero ', '1', 'FALSE', 'si', '', NULL][CAST((o_orderkey + 1 * o_custkey) % 7 AS INTEGER) + 1] AS p1_raw,
         ['TRUE', 'verdadero ', '1', 'FALSE', 'si', '', NULL][CAST((o_orderkey + 2 * o_custkey) % 7 AS INTEGER) + 1] AS p2_raw,
         ['TRUE', 'verdadero ', '1', 'FALSE', 'si', '', NULL][CAST((o_orderkey + 3 * o_custkey) % 7 AS INTEGER) + 1] AS p3_raw,
         ['TRUE', 'verdadero ', '1', 'FALSE', 'si', '', NULL][CAST((o_orderkey + 4 * o_custkey) % 7 AS INTEGER) + 1] AS p4_raw,
         CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y')
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS diffusion_raw,
         ['2026-03-31', '30-04-2026', '31/05/2026'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS cutoff_raw
  FROM base),
fu AS (
  SELECT replace(coalesce(region_raw, 'S/R'), '.0', '') AS region,
         specialist, account, holding, employer, center_id, center_name, commune, visit_status,
         {parse_bool('goal_raw')} AS goal_met,
         {parse_bool('p1_raw')} AS pillar_1, {parse_bool('p2_raw')} AS pillar_2,
         {parse_bool('p3_raw')} AS pillar_3, {parse_bool('p4_raw')} AS pillar_4,
         {parse_date('diffusion_raw')} AS diffusion_date,
         {parse_date('cutoff_raw')} AS cutoff_date
  FROM fu_raw)
"""


def with_base(body: str, extra_ctes: str = "") -> str:
    ctes = BASE_CTES.strip()
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"
