"""Queries of single operators beside the reports, each with its DuckDB SQL.

As in ``registry``, inputs are raw rows built from the driver's tables; the
expected values come from how those rows were spelled, not from the library's
own lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.constants import (H_HOLDING, H_PLANNED, MONTH_NAMES_ES, OVERDUE_STATUS, PARETO_TOP, RANKING_TOP,
                                 WEEKDAY_NAMES_ES)
from visitlens.functions.dates import date_shapes, format_date, parse_date_flexible, parse_date_report
from visitlens.operators.canonicalize import canonicalize_cell, load_canonical_map
from visitlens.operators.case_index import CaseIndex, build_case_index
from visitlens.operators.clean import clean_plan
from visitlens.operators.filters import non_blank
from visitlens.operators.lookup import anti_membership, semi_membership
from visitlens.operators.shape import drop_empty_rows, ensure_columns, relabel, rename_headers
from visitlens.constants import HEADER_ALIASES
from visitlens.plans import reports as R
from visitlens.plans.normalizer import PHASE1_SEPS, phase1_proposals, vocabulary
from visitlens.plans.vocabulary_index import add_labels, proposals
from visitlens.session import scratch_path
from visitlens.sources.payload import payload_status, payload_to_rows
from visitlens.sources.readers import read_delimited_skip
from visitlens.sources.sinks import append_rows, clear_table, number_rows, refresh_table, table_info, write_tables
from visitlens.streaming import start_payload_ingest
from visitlens.testing import oracle_queries as O
from visitlens.testing.adapter import plan_raw, table
from visitlens.testing.oracle_sql import pct, tokens, with_base
from visitlens.testing.registry import DIAGNOSIS, FACET_SELECTION, MONTH, SEGMENT, TEAM_FILTER, followup, plan

#: Spelling of a date per order: Spark's pattern letters, and text put after it.
SPELLINGS = [
    ("yyyy-MM-dd", ""), ("dd-MM-yyyy", ""), ("d/M/yyyy", " 10:30"),
    ("dd/MM/yyyy", " 9:05"), ("yyyy-MM-dd", " 10:30"), ("yyyy-MM-dd", "T10:00:00"),
    ("yyyy-MM-dd", " 10:11:12.5"), ("dd-MM-yy", " 10:00"), ("d MMM yyyy", ""),
    ("MMMM d, yyyy", ""), ("dd.MM.yyyy", ""), ("yyyyMMdd", ""),
    ("yyyy/MM/dd", ""), ("yyyy-MM-dd", "T10:00:00Z"), ("dd-MMM-yyyy", " 8:15 PM"),
]

#: ``q_delimited_skip`` deals keys to seven files, and so many of them to a file at most.
FILE_KEYS = 10_000


def q_date_spellings(spark, d):
    """Every order's date in one of many spellings, parsed."""
    k = F.col("o_orderkey") % len(SPELLINGS)
    text = F.lit(None).cast("string")
    for i, (pattern, time) in enumerate(SPELLINGS):
        text = F.when(k == i, F.concat(F.date_format("o_orderdate", pattern), F.lit(time))).otherwise(text)
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("spelled"))
    return rows.select("o_orderkey", format_date(parse_date_flexible("spelled"), "yyyy-MM-dd").alias("parsed"))


def q_date_grammar(spark, d):
    """Weekdays, ordinals, month names in two languages, compact times, zones."""
    k, o = F.col("o_orderkey") % 10, F.col("o_orderdate")
    part = lambda p: F.date_format(o, p)
    in_es = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), n)
    es_day, es_month = in_es(WEEKDAY_NAMES_ES, F.weekday(o) + 1), in_es(MONTH_NAMES_ES, F.month(o))
    join = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    text = (F.when(k == 0, part("EEE dd MMM yyyy")).when(k == 1, join(es_day, " ", part("d"), " de ", es_month, " de ", part("yyyy")))
            .when(k == 2, join(part("yyyyMMdd"), " 1030")).when(k == 3, join(part("EEEE, MMMM d"), "th, ", part("yyyy"), " 8:15 p.m."))
            .when(k == 4, join("10:30 ", part("dd/MM/yyyy"))).when(k == 5, join(part("yyyyMMdd"), "T103000Z"))
            .when(k == 6, join(F.upper(es_day), ", ", part("dd-MM-yyyy"), " 10:30:00 +03:00")).when(k == 7, join(part("d"), F.substring(es_month, 1, 3), part("yy")))
            .when(k == 8, join(part("yyyy"), " ", es_month, " ", part("d"))).otherwise(join("some ", part("EEE d MMM yyyy"))))
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("spelled"))
    return rows.select("o_orderkey", format_date(parse_date_flexible("spelled"), "yyyy-MM-dd").alias("parsed"))


def q_date_shapes(spark, d):
    """How the raw plan spells its planned dates."""
    raw = rename_headers(plan_raw(spark, d), HEADER_ALIASES).select(F.col(f"`{H_PLANNED}`").alias("planned"))
    return date_shapes(raw, ["planned"])


def q_unparsed_dates(spark, d):
    """Non-blank planned dates that are no dates."""
    raw = rename_headers(plan_raw(spark, d), HEADER_ALIASES).select(F.col(f"`{H_PLANNED}`").alias("planned"))
    return parse_date_report(raw, ["planned"])


def _mixed_payloads(spark, d):
    k, e = F.col("event_id") % 6, F.col("event_id").cast("string")
    q = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    payload = (F.when(k == 0, q('{"headers":["id","kind"],"rows":[["', e, '","', F.col("event_type"), '"]]}'))
                .when(k == 1, q('{"headers":["kind","id"],"rows":[["', F.col("event_type"), '","', e, '"]]}'))
                .when(k == 2, q('{"headers":["id","kind"],"rows":[["', e, '"]]}'))
                .when(k == 3, q('{"headers":["id","kind"],"rows":[["', e, '","x","y"]]}'))
                .when(k == 4, q('{"headers":["id"', e))
                .otherwise(q('{"rows":[["', e, '","', F.col("event_type"), '"]]}')))
    return table(spark, d, "events").select("event_id", payload.alias("payload"))


def q_payload_errors(spark, d):
    """A10: good, malformed, ragged and re-ordered payloads, one per event."""
    events = _mixed_payloads(spark, d)
    status = payload_status(events, keep=["event_id"])
    rows = payload_to_rows(events, ["id", "kind"], keep=["event_id"]).withColumnRenamed("event_id", "row_event")
    return (status.join(rows, F.col("event_id") == F.col("row_event"), "left")
            .select("event_id", "status", "error", F.col("rows").cast("bigint").alias("n_rows"), "id", "kind"))


def q_payload_stream(spark, d):
    """A10 as a stream, run, then run again without its checkpoint: every payload is
    in the log once, and the table has the rows of the good ones once."""
    base = scratch_path(spark, "payload_stream")
    _mixed_payloads(spark, d).select("payload").repartition(6).write.json(f"{base}/in")
    for run in (1, 2):
        start_payload_ingest(spark, f"{base}/in", f"{base}/table", ["id", "kind"], f"{base}/state{run}", max_files_per_trigger=4).awaitTermination()
    log = spark.read.parquet(f"{base}/table_log").groupBy("status", "error").agg(F.count("*").alias("payloads"), F.sum("rows").alias("n_rows"))
    rows = spark.read.parquet(f"{base}/table").agg(F.lit("table").alias("status"), F.lit(None).cast("string").alias("error"),
                                                   F.count_distinct("id").alias("payloads"), F.count("*").alias("n_rows"))
    return log.unionByName(rows)


def q_numbered_rows(spark, d):
    """A numbered table refreshed, appended to twice and refreshed from itself."""
    path = scratch_path(spark, "numbered")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    lines = [li.filter(F.col("l_linenumber") == n).orderBy("l_orderkey") for n in (1, 2, 3)]
    refresh_table(lines[0], path, numbered=True)
    for batch in lines[1:]:
        append_rows(batch.select(F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y")), path)
    refresh_table(spark.read.parquet(path).withColumn("l_linenumber", F.col("l_linenumber") * 10), path)
    return spark.read.parquet(path).select(F.col("_row").alias("nth"), "l_orderkey", F.col("l_linenumber").cast("int").alias("line"))


def q_numbered_info(spark, d):
    """Rows and first cell of a numbered table, without a column that orders it."""
    path = scratch_path(spark, "numbered_info")
    refresh_table(table(spark, d, "customer").orderBy(F.desc("c_custkey")).select("c_name", "c_custkey"), path, numbered=True)
    return table_info(spark.read.parquet(path))


def q_delimited_skip(spark, d):
    """A3: a folder of files, each with a preamble, quotes and line breaks."""
    path = scratch_path(spark, "delimited_skip")
    file = F.floor(F.col("c_custkey") / (7 * FILE_KEYS)) * 7 + F.col("c_custkey") % 7
    cust = table(spark, d, "customer").select("c_custkey", "c_name", file.alias("file"))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), F.col("c_name"), F.lit(' ""x"", a\nb"'))
    heads = cust.select("file").distinct().select("file", F.lit(None).cast("bigint").alias("at"),
                                                  F.lit('title "of\nversion 3\n\nid,label').alias("value"))
    rows = cust.select("file", F.col("c_custkey").cast("bigint").alias("at"), line.alias("value"))
    (heads.unionByName(rows).repartition("file").sortWithinPartitions("file", "at")  # the preamble first
     .select("value", "file").write.partitionBy("file").text(path))
    return read_delimited_skip(spark, f"{path}/file=*", 3).select(F.col("id").cast("bigint").alias("id"), "label")


def q_delimited_records(spark, d):
    """A3: cells of 100,000 characters and more without quotes, quotes that belong to
    the text, line breaks in cells, and files that name their columns in another order."""
    path = scratch_path(spark, "delimited_records")
    key = F.col("p_partkey").cast("bigint")
    file = F.floor(key / (7 * FILE_KEYS)) * 7 + key % 7
    label = (F.when(key % 500 == 3, F.concat(F.repeat(F.lit("long "), 20_000 + (key % 7).cast("int")), F.col("p_name")))
             .when(key % 5 == 0, F.concat(F.lit('5" of '), F.col("p_name")))
             .when(key % 5 == 1, F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""x""\n\n,'), key.cast("string"), F.lit('"')))
             .when(key % 5 == 2, F.lit('""')).otherwise(F.col("p_name")))
    parts = table(spark, d, "part").select(key.alias("key"), file.alias("file"), label.alias("label"))
    swapped = F.col("file") % 2 == 1
    heads = parts.select("file").distinct().select("file", F.lit(None).cast("bigint").alias("key"),
                                                   F.when(swapped, F.lit('say "hi\nlabel,size,id')).otherwise(F.lit('title\nid,label')).alias("value"))
    rows = parts.select("file", "key", F.when(swapped, F.concat("label", F.lit(","), F.length("label"), F.lit(","), "key"))
                        .otherwise(F.concat("key", F.lit(","), "label")).alias("value"))
    (heads.unionByName(rows).repartition("file").sortWithinPartitions("file", "key")
     .select("value", "file").write.partitionBy("file").text(path))
    got = read_delimited_skip(spark, f"{path}/file=*", 1)
    return got.select(F.col("id").cast("bigint").alias("id"), F.length("label").cast("bigint").alias("chars"), F.md5("label").alias("label"),
                      F.col("size").cast("bigint").alias("written"))


def q_canonical_map(spark, d):
    """A4: a reviewed table with blank, NULL, NA and repeated variants."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("  ")).alias("variante"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 11 == 0, F.lit("N/A"))
         .otherwise(F.concat(F.lit(" "), F.col("p_brand"))).alias("canonical_propuesto"), k.alias("orden"))
    return load_canonical_map(rows)


def _items(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o, n, s = (F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey"))
    cell = (F.when(F.col("l_suppkey") % 9 == 0, F.lit(None).cast("string")).when(F.col("l_suppkey") % 9 == 1, F.lit("  "))
             .otherwise(F.concat(F.lit("Item "), o, F.lit("-"), n, F.lit(", None "), s, F.lit(", || item "), o, F.lit("-1"))))
    # ids repeat, some are NULL
    rows = li.select(F.when(F.col("l_orderkey") % 5 != 0, F.col("l_orderkey") % 50).alias("id"), cell.alias("cell"))
    mapping = li.select(F.concat(F.lit("item "), o, F.lit("-"), n).alias("variante"),
                        F.concat(F.lit("label "), (F.col("l_orderkey") % 97).cast("string"), F.lit("/"), n).alias("canonical_propuesto"),
                        F.col("l_suppkey").alias("orden"))
    return rows, mapping


def q_canonicalized_duplicate_keys(spark, d):
    """Repeated and NULL ids, NULL and blank cells, a map row per line."""
    rows, mapping = _items(spark, d)
    return canonicalize_cell(rows, "cell", load_canonical_map(mapping), out="rewritten")


def q_ensured_columns(spark, d):
    """A missing column with its default, NULLs of another filled."""
    raw = plan_raw(spark, d).select(F.col("ID-CT").alias("center_id"), F.col(H_HOLDING).alias("holding"))
    return ensure_columns(raw, {"holding": "none", "extra": "new"})


def q_relabelled_detail(spark, d):
    """Visit detail under display labels."""
    return relabel(R.visit_detail(plan(spark, d).filter(F.col("planned_date").isNotNull())),
                   {"date_text": "Fecha", "center_name": "Centro", "no such column": "x"})


def q_nonempty_rows(spark, d):
    """Raw rows with any cell in three columns."""
    raw = plan_raw(spark, d)
    return drop_empty_rows(raw.select(F.col("Region").alias("region"), F.col("Ergonomo").alias("specialist"), F.col("Holding").alias("holding")))


def q_non_blank_dates(spark, d):
    """Raw rows with a planned date cell that is not blank."""
    raw = rename_headers(plan_raw(spark, d), HEADER_ALIASES)
    return non_blank(raw.select(F.col("ID-CT").alias("center_id"), F.col(f"`{H_PLANNED}`").alias("planned")), "planned")


def q_written_tables(spark, d):
    """A5: two tables written in one export and counted from what was written."""
    path = scratch_path(spark, "export")
    write_tables({"plan": R.plan_sheet(plan(spark, d)), "detail": R.followup_detail(followup(spark, d))}, path)
    out = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in ("plan", "detail")]
    return out[0].unionByName(out[1])


def q_cleared_table(spark, d):
    """A full table cleared, then filled with the unscheduled visits."""
    path = scratch_path(spark, "cleared")
    ids = plan(spark, d).select("center_id", "planned_date")
    refresh_table(ids.select("center_id"), path)
    clear_table(spark, path)
    append_rows(ids.filter(F.col("planned_date").isNull()).select("center_id"), path)
    return spark.read.parquet(path)


def q_membership(spark, d):
    """Employers of scheduled visits that have, and have not, a met goal."""
    p = plan(spark, d).filter(F.col("planned_date").isNotNull() & F.col("employer").isNotNull())
    met = followup(spark, d).filter("goal_met")
    with_goal = semi_membership(p, "employer", met, "employer").agg(F.lit("met").alias("kind"), F.count("*").alias("visits"))
    return with_goal.unionByName(anti_membership(p, "employer", met, "employer").agg(F.lit("not").alias("kind"), F.count("*").alias("visits")))


def q_pareto_drill(spark, d):
    """Pareto of occupations and the drill-down's tasks in one segment."""
    page = R.pareto_drill_page(plan(spark, d), {}, SEGMENT)
    return (page["pareto_pareto"].select(F.lit("pareto").alias("part"), "name", "cnt")
            .unionByName(page["drill_tasks"].select(F.lit("tasks").alias("part"), "name", "cnt")))


def q_plan_sheet(spark, d):
    """The plain plan sheet by real date."""
    return R.plan_sheet(clean_plan(plan_raw(spark, d))).withColumn("planned_date", format_date("planned_date", "yyyy-MM-dd"))


def _parts(page, parts):
    """Tables of a page as rows (part, name, cnt): {table: (name column, count column)}."""
    out = [page[t].select(F.lit(t).alias("part"), (F.col(n) if n else F.lit(None)).cast("string").alias("name"), F.col(c).cast("bigint").alias("cnt"))
           for t, (n, c) in parts.items()]
    return reduce(DataFrame.unionByName, out)


def _summary(page, table):
    return reduce(DataFrame.unionByName, [page[table].select(F.lit(table).alias("part"), F.lit(c).alias("name"), F.col(c).cast("bigint").alias("cnt"))
                                          for c in page[table].columns])


def q_programme_page(spark, d):
    """Every table of the programme page, from one scan of the plan."""
    page = R.programme_page(plan(spark, d), TEAM_FILTER)
    return _parts(page, {"monthly_load": ("month", "cnt"), "by_region": ("region", "cnt"), "top_specialists": ("specialist", "cnt"),
                         "top_communes": ("commune", "cnt")}).unionByName(_summary(page, "worker_totals"))


def q_followup_page(spark, d):
    """KPIs and crosstab of one selection."""
    page = R.followup_page(plan(spark, d), followup(spark, d), TEAM_FILTER)
    cross = _parts(page | {"n_false": page["region_goal"], "n_true": page["region_goal"]}, {"n_false": ("region", "n_false"), "n_true": ("region", "n_true")})
    kpis = page["kpi_global"].select("scheduled", "goals_met", "n_cases", "employers_with_cases")
    sums = page["kpi_followup"].select("overdue", *[f"pillar_{i}_n" for i in (1, 2, 3, 4)])
    return cross.unionByName(_summary({"kpis": kpis}, "kpis")).unionByName(_summary({"sums": sums}, "sums"))


def q_case_page(spark, d):
    """Summary, rankings and the Pareto of one segment."""
    page = R.case_page(plan(spark, d), TEAM_FILTER, SEGMENT, "tasks")
    return _parts(page, {"top_diagnoses": ("name", "cnt"), "top_employers": ("employer", "n_cases"), "pareto": ("name", "cnt")}) \
        .unionByName(_summary(page, "summary"))


def q_drill_page(spark, d):
    """P10: drill-down by a whole diagnosis token, with the diagnoses to choose from."""
    page = R.drill_page(plan(spark, d), {}, "diagnoses", DIAGNOSIS + "1", whole_token=True)
    options = number_rows(page["diagnosis_options"]).select(F.lit("options").alias("part"), "name", F.col("_row").alias("cnt"))
    return (_parts(page, {"employers": ("employer", "n_cases"), "occupations": ("name", "cnt"), "tasks": ("name", "cnt")})
            .unionByName(_summary(page, "summary")).unionByName(options))


def q_visit_table(spark, d):
    """The visit detail as shown, numbered in its order."""
    return number_rows(R.visit_table(plan(spark, d).filter(F.col("planned_date").isNotNull())))


def q_proposal_order(spark, d):
    """H2: proposals numbered in their order."""
    rows = phase1_proposals(plan_raw(spark, d, dirty_tasks=True), seps={"tareas": PHASE1_SEPS["tareas"]})["tareas"]
    return number_rows(rows)


def q_indicator_order(spark, d):
    """H5: the indicator table and its chart, numbered in their orders."""
    page = R.indicators_page(followup(spark, d), TEAM_FILTER)
    return reduce(DataFrame.unionByName, [number_rows(page[t]).select(F.lit(t).alias("part"), "_row", "specialist", "pct_goal") for t in ("indicators", "indicators_chart")])


def q_incremental_proposals(spark, d):
    """Proposals of a vocabulary that came in three lots, some labels twice."""
    path = scratch_path(spark, "vocabulary")
    words = vocabulary(plan_raw(spark, d, dirty_tasks=True), {"tareas": PHASE1_SEPS["tareas"]})
    lot = F.pmod(F.crc32(F.col("value").cast("binary")), F.lit(4))
    for lots in ((0, 1), (1, 2), (3, 0)):
        add_labels(words.filter(lot.isin(*lots)), path)
    return proposals(spark, path).select(F.col("variant").alias("variante"), F.col("canonical").alias("canonical_propuesto"),
                                         F.col("similarity").alias("similitud"))


def _index(spark, d):
    path = scratch_path(spark, "case_index")
    build_case_index(plan(spark, d), followup(spark, d), path)
    return CaseIndex(spark, path)


def q_indexed_kpis(spark, d):
    """F17-F19 of one selection and all, from the stored index."""
    index = _index(spark, d)
    out = []
    for name, sel in (("all", {}), ("account", TEAM_FILTER), ("region", {"region": "3"})):
        out += [index.kpi_global(sel, MONTH).select(F.lit(name).alias("part"), F.lit("kpi").alias("kind"), "scheduled", "n_cases", F.col("employers_with_cases").alias("employers")),
                index.case_summary(sel).select(F.lit(name), F.lit("summary"), "n_visits", "n_cases", "n_employers")]
    return reduce(DataFrame.union, out)


def q_indexed_cases(spark, d):
    """Distinct cases per employer and per region, facet options, from the index."""
    index = _index(spark, d)
    per = [index.cases_by(f, TEAM_FILTER).select(F.lit(f).alias("part"), F.col(f).alias("name"), F.col("n_cases").cast("bigint").alias("cnt")) for f in ("employer", "region")]
    options = index.facet_options(FACET_SELECTION).select("facet", "value", F.lit(0).cast("bigint"))
    return reduce(DataFrame.union, [*per, options])


CHECKS = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}


def check_sql() -> dict[str, str]:
    item = "'item ' || l_orderkey || '-' ||"
    seg = f"(SELECT * FROM plan WHERE has_case AND {O.contains('segments', SEGMENT)})"
    return {
        "date_spellings": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders",
        "date_grammar": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 9 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders",
        "date_shapes": """
SELECT 'planned' AS column, CASE o_orderkey % 7 WHEN 2 THEN 'a a' WHEN 3 THEN '99-99-9999' WHEN 4 THEN '99/99/9999' ELSE '9999-99-99' END AS shape,
       count(*) AS cells, count(*) FILTER (WHERE o_orderkey % 7 <> 2) AS parsed FROM orders WHERE o_orderkey % 7 > 1 GROUP BY ALL""",
        "unparsed_dates": "SELECT count(*) AS planned FROM orders WHERE o_orderkey % 7 = 2",
        "payload_errors": """
SELECT event_id, CASE WHEN event_id % 6 IN (2, 3, 4) THEN 'error' ELSE 'ok' END AS status,
       CASE event_id % 6 WHEN 2 THEN 'row width differs from header' WHEN 3 THEN 'row width differs from header'
                         WHEN 4 THEN 'malformed payload' END AS error,
       CASE WHEN event_id % 6 IN (2, 3, 4) THEN 0 ELSE 1 END AS n_rows,
       CASE WHEN event_id % 6 IN (0, 1, 5) THEN CAST(event_id AS VARCHAR) END AS id,
       CASE WHEN event_id % 6 IN (0, 1, 5) THEN event_type END AS kind FROM events""",
        "payload_stream": """
SELECT CASE WHEN event_id % 6 IN (2, 3, 4) THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN event_id % 6 IN (2, 3) THEN 'row width differs from header' WHEN event_id % 6 = 4 THEN 'malformed payload' END AS error,
       count(*) AS payloads, count(*) FILTER (WHERE event_id % 6 IN (0, 1, 5)) AS n_rows FROM events GROUP BY 1, 2
UNION ALL SELECT 'table', NULL, count(*), count(*) FROM events WHERE event_id % 6 IN (0, 1, 5)""",
        "numbered_rows": """
SELECT row_number() OVER (ORDER BY l_linenumber, l_orderkey) AS nth, l_orderkey, CAST(l_linenumber * 10 AS INTEGER) AS line
FROM lineitem WHERE l_linenumber <= 3""",
        "numbered_info": "SELECT count(*) AS rows, max_by(c_name, c_custkey) AS updated FROM customer",
        "delimited_skip": "SELECT c_custkey AS id, c_name || ' \"x\", a' || chr(10) || 'b' AS label FROM customer",
        "delimited_records": """
WITH cells AS (
  SELECT p_partkey AS id, (p_partkey // 70000 * 7 + p_partkey % 7) % 2 = 1 AS swapped,
         CASE WHEN p_partkey % 500 = 3 THEN repeat('long ', 20000 + p_partkey % 7) || p_name
              WHEN p_partkey % 5 = 0 THEN '5" of ' || p_name
              WHEN p_partkey % 5 = 1 THEN p_name || ', "x"' || chr(10) || chr(10) || ',' || p_partkey
              WHEN p_partkey % 5 = 3 OR p_partkey % 5 = 4 THEN p_name END AS label,
         CASE WHEN p_partkey % 500 <> 3 AND p_partkey % 5 = 1 THEN 4 WHEN p_partkey % 500 <> 3 AND p_partkey % 5 = 2 THEN 2 ELSE 0 END AS marks FROM part)
SELECT id, length(label) AS chars, md5(label) AS label, CASE WHEN swapped THEN coalesce(length(label), 0) + marks END AS written FROM cells""",
        "programme_page": with_base(f"""
SELECT 'monthly_load' AS part, CAST(month AS VARCHAR) AS name, count(*) AS cnt FROM prog GROUP BY month
UNION ALL SELECT 'by_region', region, count(*) FROM prog GROUP BY region
UNION ALL (SELECT 'top_specialists', specialist, count(*) FROM prog GROUP BY specialist ORDER BY 3 DESC, 2 LIMIT {RANKING_TOP})
UNION ALL (SELECT 'top_communes', commune, count(*) FROM prog GROUP BY commune ORDER BY 3 DESC, 2 LIMIT {RANKING_TOP})
UNION ALL SELECT 'worker_totals', 'total_workers', CAST(sum(coalesce(men, 0) + coalesce(women, 0)) AS BIGINT) FROM prog
UNION ALL SELECT 'worker_totals', 'total_men', CAST(sum(men) AS BIGINT) FROM prog
UNION ALL SELECT 'worker_totals', 'total_women', CAST(sum(women) AS BIGINT) FROM prog""", f"""
prog AS (SELECT * FROM plan WHERE planned_date IS NOT NULL AND account = '{TEAM_FILTER['account']}')"""),
        "followup_page": with_base(f"""
SELECT 'n_false' AS part, region AS name, count(*) FILTER (WHERE NOT goal_met) AS cnt FROM f GROUP BY region
UNION ALL SELECT 'n_true', region, count(*) FILTER (WHERE goal_met) FROM f GROUP BY region
UNION ALL SELECT 'kpis', 'scheduled', count(*) FROM p WHERE planned_date IS NOT NULL
UNION ALL SELECT 'kpis', 'goals_met', count(*) FROM f WHERE goal_met
UNION ALL SELECT 'kpis', 'n_cases', count(DISTINCT c) FROM (SELECT unnest({tokens('case_ids', ['||'])}) AS c FROM p)
UNION ALL SELECT 'kpis', 'employers_with_cases', count(DISTINCT employer) FROM p WHERE has_case
UNION ALL SELECT 'sums', 'overdue', count(*) FROM f WHERE visit_status = '{OVERDUE_STATUS}'
""" + "".join(f"UNION ALL SELECT 'sums', 'pillar_{i}_n', count(*) FROM f WHERE pillar_{i}\n" for i in (1, 2, 3, 4)), f"""
f AS (SELECT * FROM fu WHERE account = '{TEAM_FILTER['account']}'), p AS (SELECT * FROM plan WHERE account = '{TEAM_FILTER['account']}')"""),
        "case_page": with_base(f"""
(SELECT 'top_diagnoses' AS part, name, cnt FROM ({O.ranking('ep', 'diagnoses', ['||', ','])}) ORDER BY cnt DESC, name LIMIT {RANKING_TOP})
UNION ALL (SELECT 'top_employers', employer, n_cases FROM ({O.cases_per_employer_sql('ep')}) ORDER BY n_cases DESC, employer LIMIT {RANKING_TOP})
UNION ALL (SELECT 'pareto', name, cnt FROM ({O.ranking('seg', 'tasks', ['||', ','])}) ORDER BY cnt DESC, name LIMIT {PARETO_TOP})
UNION ALL SELECT 'summary', 'n_cases', n_cases FROM s UNION ALL SELECT 'summary', 'n_employers', n_employers FROM s
UNION ALL SELECT 'summary', 'n_visits', n_visits FROM s""", f"""
ep AS (SELECT * FROM plan WHERE has_case AND account = '{TEAM_FILTER['account']}'),
seg AS (SELECT * FROM ep WHERE {O.contains('segments', SEGMENT)}), s AS ({O.case_summary_sql('ep')})"""),
        "drill_page": with_base(f"""
SELECT 'employers' AS part, employer AS name, n_cases AS cnt FROM ({O.cases_per_employer_sql('dr')})
UNION ALL SELECT 'occupations', name, cnt FROM ({O.ranking('dr', 'occupations', ['||', ' | '])})
UNION ALL SELECT 'tasks', name, cnt FROM ({O.ranking('dr', 'tasks', ['||', ','])})
UNION ALL SELECT 'options', name, row_number() OVER (ORDER BY name) FROM ({O.ranking('ep', 'diagnoses', ['||', ','])})
UNION ALL SELECT 'summary', 'n_cases', n_cases FROM s UNION ALL SELECT 'summary', 'n_employers', n_employers FROM s
UNION ALL SELECT 'summary', 'n_visits', n_visits FROM s""", f"""
ep AS (SELECT * FROM plan WHERE has_case),
dr AS (SELECT * FROM ep WHERE list_contains({tokens('diagnoses', ['||', ','])}, '{DIAGNOSIS}1')), s AS ({O.case_summary_sql('dr')})"""),
        "visit_table": with_base("""
SELECT row_number() OVER (ORDER BY planned_date, center_name) AS "_row", strftime(planned_date, '%d-%m-%Y') AS "Fecha", region AS "Region",
       specialist AS "Ergónomo", employer AS "Nombre Empleador", center_name AS "Centro de Trabajo", commune AS "Comuna", address AS "Dirección",
       men AS "N° Hombres", women AS "N° Mujeres", coalesce(men, 0.0) + coalesce(women, 0.0) AS "Total Trabajadores"
FROM plan WHERE planned_date IS NOT NULL"""),
        "proposal_order": f"""
SELECT row_number() OVER (ORDER BY canonical_propuesto, similitud DESC, variante) AS "_row", * FROM ({O.build_extra()['canonical_proposals']})""",
        "indexed_kpis": with_base("\nUNION ALL\n".join(f"""
SELECT '{name}' AS part, 'kpi' AS kind, (SELECT count(*) FROM p WHERE planned_date IS NOT NULL AND month = {MONTH}) AS scheduled,
       (SELECT count(DISTINCT c) FROM (SELECT unnest({tokens('case_ids', ['||'])}) AS c FROM p)) AS n_cases,
       (SELECT count(DISTINCT employer) FROM p WHERE has_case) AS employers
UNION ALL SELECT '{name}', 'summary', n_visits, n_cases, n_employers FROM ({O.case_summary_sql('(SELECT * FROM p WHERE has_case)')})"""
            .replace(" p ", f" (SELECT * FROM plan WHERE {cond}) ").replace(" p)", f" (SELECT * FROM plan WHERE {cond}))")
            for name, cond in (("all", "true"), ("account", f"account = '{TEAM_FILTER['account']}'"), ("region", "region = '3'")))),
        "indexed_cases": with_base(f"""
SELECT 'employer' AS part, employer AS name, n_cases AS cnt FROM ({O.cases_per_employer_sql('p')})
UNION ALL SELECT 'region', region, count(DISTINCT c) FROM (SELECT region, unnest({tokens('case_ids', ['||'])}) AS c FROM p) GROUP BY region
UNION ALL SELECT facet, value, 0 FROM ({O.facet_options_sql(FACET_SELECTION)})""",
            f"p AS (SELECT * FROM plan WHERE account = '{TEAM_FILTER['account']}')"),
        "incremental_proposals": O.build_extra()["canonical_proposals"],
        "indicator_order": with_base(f"""
SELECT t.part, row_number() OVER (PARTITION BY t.part ORDER BY t.sign * pct_goal, specialist) AS "_row", specialist, pct_goal
FROM (SELECT specialist, {pct('goals', 'centers')} AS pct_goal FROM i), (VALUES ('indicators', -1), ('indicators_chart', 1)) t(part, sign)""",
            O.indicators_cte("i", f"(SELECT * FROM fu WHERE account = '{TEAM_FILTER['account']}')")),
        "canonical_map": """
SELECT split_part(p_name, ' ', 1) AS variant, arg_max(p_brand, p_partkey) AS canonical
FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 GROUP BY 1""",
        "canonicalized_duplicate_keys": f"""
WITH m AS (SELECT DISTINCT {item} l_linenumber AS v, upper('label ' || l_orderkey % 97 || '/' || l_linenumber) AS c FROM lineitem)
SELECT CASE WHEN l_orderkey % 5 <> 0 THEN l_orderkey % 50 END AS id,
       CASE l_suppkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '  '
            ELSE 'Item ' || l_orderkey || '-' || l_linenumber || ', None ' || l_suppkey || ', || item ' || l_orderkey || '-1' END AS cell,
       CASE l_suppkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '  '
            ELSE a.c || ',NONE ' || l_suppkey || ',||' || coalesce(b.c, upper({item} '1')) END AS rewritten
FROM lineitem JOIN m a ON a.v = {item} l_linenumber LEFT JOIN m b ON b.v = {item} '1'""",
        "ensured_columns": with_base("SELECT center_id, coalesce(holding_raw, 'none') AS holding, 'new' AS extra FROM plan_raw"),
        "relabelled_detail": with_base("""
SELECT strftime(planned_date, '%d-%m-%Y') AS "Fecha", region, specialist, employer, center_name AS "Centro", commune,
       address, men, women, coalesce(men, 0.0) + coalesce(women, 0.0) AS total_workers FROM plan WHERE planned_date IS NOT NULL"""),
        "nonempty_rows": with_base("""
SELECT region_raw AS region, specialist_raw AS specialist, holding_raw AS holding FROM plan_raw
WHERE region_raw IS NOT NULL OR specialist_raw IS NOT NULL OR holding_raw IS NOT NULL"""),
        "non_blank_dates": with_base("SELECT center_id, planned_raw AS planned FROM plan_raw WHERE coalesce(planned_raw, '') <> ''"),
        "written_tables": "SELECT 'plan' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'detail', count(*) FROM orders",
        "cleared_table": with_base("SELECT center_id FROM plan WHERE planned_date IS NULL"),
        "membership": with_base("""
SELECT CASE WHEN employer IN (SELECT employer FROM fu WHERE goal_met) THEN 'met' ELSE 'not' END AS kind, count(*) AS visits
FROM plan WHERE planned_date IS NOT NULL AND employer IS NOT NULL GROUP BY 1"""),
        "pareto_drill": with_base(f"""
SELECT 'pareto' AS part, name, cnt FROM ({O.pareto_sql(seg, 'occupations', ['||', ' | '])})
UNION ALL SELECT 'tasks', name, cnt FROM ({O.ranking(seg, 'tasks', ['||', ','])})"""),
        "plan_sheet": with_base("""
SELECT strftime(planned_date, '%Y-%m-%d') AS planned_date, region, specialist, account, holding, employer, center_name, address,
       commune, men, women FROM plan"""),
    }
