"""Work that must grow with the input: tables are built once, ties are spread, long lines need no recursion."""

import pytest
from pyspark.sql import functions as F

from visitlens.operators import measures
from visitlens.plans import reports as R
from visitlens.sources.records import _ends_quoted
from visitlens.testing import registry


def _plan(spark, rows=400):
    i = F.col("id")
    text = lambda x: F.concat(F.lit(x), (i % 7).cast("string"))
    return spark.range(rows).select(
        F.lit(None).cast("date").alias("planned_date"), F.lit(None).cast("int").alias("month"), text("r").alias("region"), text("s").alias("specialist"),
        text("a").alias("account"), text("h").alias("holding"), text("e").alias("employer"), F.concat(F.lit("CT-"), i.cast("string")).alias("center_name"),
        text("street ").alias("address"), text("c").alias("commune"), F.lit(1.0).alias("men"), F.lit(None).cast("double").alias("women"),
        (i % 2 == 0).alias("has_case"), F.when(i % 2 == 0, F.concat(F.lit("F"), i.cast("string"))).otherwise(F.lit("")).alias("case_ids"),
        F.lit("OP A | OP B").alias("occupations"), F.lit("lift, pull").alias("tasks"), F.lit("x").alias("diagnoses"),
        F.when(i % 4 == 0, F.lit("LUMBAR")).otherwise(F.lit("MANO_DER")).alias("segments"), F.lit("").alias("icd10"), F.lit("").alias("notes"))


def _counted(spark, df, column):
    """``df`` and an accumulator of the times that a row's column was made."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    return df.withColumn(column, F.udf(seen, "string").asNondeterministic()(column)), made


def test_plan_sheet_spreads_visits_without_date(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sheet = R.plan_sheet(_plan(spark, 4000).repartition(4))
        parts = sheet.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in parts) == 4000 and max(r["count"] for r in parts) < 2000


def _open_after(line, inside, sep):
    """The states of a line, character by character."""
    quoted, i, start = inside, 0, True
    while i < len(line):
        if quoted and line[i] == '"':
            if line[i + 1:i + 2] == '"':
                i += 1
            else:
                quoted = False
        elif not quoted and line[i] == '"' and (start or line[:i].endswith(sep)):
            quoted = True
        start = False
        i += 1
    return quoted


@pytest.mark.parametrize("sep", [",", "||"])
def test_line_states(spark, sep):
    lines = ["", '"', '""', '"""', 'a"b', 'a,"b', '"a","b', '"a""b', '"a"b,"c', 'a,"",', '",', '","', '||"x', '"a"||"b', 'a"||"b', ',"a"",""b"', ',"a"",""b"",',
             '"' + "x" * 200_000 + '""' * 50_000, '"a",' * 50_000 + '"']
    df = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, line string")
    states = df.select("n", *[_ends_quoted(F.col("line"), inside, '"', sep).alias(str(inside)) for inside in (False, True)])
    assert "aggregate(" not in states._jdf.queryExecution().analyzed().toString()  # no interpreted loop over a line's parts
    assert [(r["False"], r["True"]) for r in states.orderBy("n").collect()] == [tuple(_open_after(x, inside, sep) for inside in (False, True)) for x in lines]


def test_pareto_and_drill_are_counted_together(spark, monkeypatch):
    p, calls = _plan(spark), []
    alone = {f"pareto_{k}": v for k, v in R.case_page(p, {}, "LUMBAR").items()} | {f"drill_{k}": v for k, v in R.drill_page(p, {}, "segments", "LUMBAR").items()}
    real = measures.measured
    monkeypatch.setattr(measures, "measured", lambda df, entries: calls.append(1) or real(df, entries))
    page = R.pareto_drill_page(p, {}, "LUMBAR")
    assert len(calls) == 1 and page.keys() == alone.keys()
    for name, table in page.items():
        assert table.columns == alone[name].columns, name
        assert sorted(map(str, table.collect())) == sorted(map(str, alone[name].collect())), name


@pytest.mark.parametrize("name", ["canonicalized", "change_stats"])
def test_normaliser_builds_its_input_once(spark, monkeypatch, name):
    rows = spark.createDataFrame([(str(i), f"Operator {i % 3} || Cook", "lift boxes, lift box" if i % 2 else "lift boxes") for i in range(30)], "`ID-CT` string, ocupaciones string, tareas string")
    raw, made = _counted(spark, rows, "tareas")
    monkeypatch.setattr(registry, "plan_raw", lambda *a, **k: raw)
    got = registry.QUERIES[name](spark, "").collect()
    assert made.value == 30
    assert len(got) == 30 and {r["tasks"] for r in got} == {"LIFT BOXES,LIFT BOXES", "LIFT BOXES"} if name == "canonicalized" else got[0]["changed_tareas"] == 30


def test_index_reads_the_plan_once_and_stores_words(spark, tmp_path):
    from visitlens.operators.case_index import CaseIndex, build_case_index
    fu = registry.followup(spark, "/root/testdata/sf0.001")
    plan, made = _counted(spark, _plan(spark), "case_ids")
    build_case_index(plan, fu, str(tmp_path))
    assert made.value == 400
    index = CaseIndex(spark, str(tmp_path))
    # 200 cases, more than a word's; a word of a combination takes eight bytes, not a block of 4,096
    assert dict(index.bits.dtypes)["bits"] == "bigint" and index.bits.count() <= 200
    assert index.case_summary({}).collect() == [(200, 7, 200)]
    assert {r.employer: r.n_cases for r in index.cases_by("employer").collect()} == {f"e{k}": sum(i % 7 == k for i in range(0, 400, 2)) for k in range(7)}


def test_date_grammar_stands_in_the_plan_once(spark):
    from visitlens.functions.dates import parse_date_flexible
    df = spark.range(1).select(parse_date_flexible(F.col("id").cast("string")).alias("d"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_items_do_not_carry_their_cell(spark):
    import hashlib
    import time
    from visitlens.operators.canonicalize import canonicalize_cell
    items = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(1500)]
    cell = ", ".join(items)

    def shuffled():
        time.sleep(2)
        return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    rows = spark.createDataFrame([(cell,), (" ,||",), ("||",), (" ",), (None,)], "cell string")
    mapping = spark.createDataFrame([(items[0], "First")], "variant string, canonical string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        out = {r.cell: r.new for r in canonicalize_cell(rows, "cell", mapping, out="new").collect()}
        assert shuffled() - before < 20_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert out == {cell: ",".join(["FIRST", *[i.upper() for i in items[1:]]]), " ,||": ",||", "||": "||", " ": " ", None: None}


def test_plain_texts_normalise_as_all(spark):
    from visitlens.functions.text import normalize_text
    texts = {" Lift  Box ": "lift box", "lift box": "lift box", "  a": "a", "a\tb": "a b", "Ñandú / (x).-": "nandu / (x).-", "a # b": "a  b", "": "", None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", normalize_text("t").alias("n")).collect()} == texts


def test_canonicalize_frees_its_shuffles(spark):
    """Neither shuffle files nor written tables of the dictionary's jobs are left: they
    added up on disk until the last join ended."""
    import os
    from visitlens.operators.canonicalize import canonicalize_cells, rewritten_cells
    from visitlens.session import checkpoint_dir

    dirs = [str(d) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]
    held = lambda: {f for d in dirs for b, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    tables = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    written = lambda: set(os.listdir(tables)) if os.path.isdir(tables) else set()
    data = [(f"Item {i}, none {i % 7} ,,\u00a0||  ITEM {i}, \u00bf, ||\u00e1\u00bfrbol  x" if i % 5 else None, f"B {i % 3}||c" if i % 4 else " ") for i in range(300)]
    rows = spark.createDataFrame(data, "a string, b string")
    few = spark.createDataFrame([(f"item {i}", f"label {i}") for i in range(0, 300, 2)] + [("", "nothing"), ("none 3", None)], "variant string, canonical string")
    other = spark.createDataFrame([("b 1", "one")], "variant string, canonical string")
    maps, seps = {"a": few, "b": other}, {"a": ("||", ","), "b": ("||", "||")}
    shuffles, scratch = held(), written()
    found = rewritten_cells(rows, maps, seps)
    assert not held() - shuffles and written() == scratch
    assert found.count() == len({a for a, _ in data if a}) + 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

    def new(i):
        item = f"LABEL {i}" if i % 2 == 0 else f"ITEM {i}"
        return f"{item},NONE {i % 7},,||{item},NOTHING,||ARBOL X"
    want = {(i, new(i) if i % 5 else None, ("ONE" if i % 3 == 1 else f"B {i % 3}") + "||C" if i % 4 else " ") for i in range(300)}
    got = canonicalize_cells(rows.withColumn("i", F.monotonically_increasing_id()), maps, seps).select("a", "b").collect()
    assert sorted((r.a or "", r.b) for r in got) == sorted((a or "", b) for _, a, b in want)
