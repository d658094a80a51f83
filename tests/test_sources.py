"""Sinks, payloads, delimited reads and the streaming ingest."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from visitlens.sources.payload import build_payload, payload_status, payload_to_rows
from visitlens.sources.readers import malformed_rows, read_delimited_skip, read_followup, read_plan, register, sql
from visitlens.sources.records import cut_records, read_lines
from visitlens.sources.sinks import (append_rows, clear_table, init_table, read_table, refresh_table, table_info,
                                     write_tables)
from visitlens.streaming import start_payload_ingest


def test_payload_roundtrip(spark):
    df = spark.createDataFrame([('{"headers":["a","b"],"rows":[["1","2"],["3","4"]]}',),
                                ('{"headers":["a","b"],"rows":[]}',), ('{"headers":["a","b"]}',)], "payload string")
    rows = payload_to_rows(df, ["a", "b"]).orderBy("row_no").collect()
    assert [(r.row_no, r.a, r.b) for r in rows] == [(0, "1", "2"), (1, "3", "4")]
    src = spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (2, 12, "z"), (1, 12, "w")], "g int, o int, v string")
    p = build_payload(src, ["g"], ["o", "v"], "o").orderBy("g").collect()
    assert json.loads(p[0].payload) == {"headers": ["o", "v"], "rows": [["10", "x"], ["11", "y"], ["12", "w"]]}
    chunks = build_payload(src, ["g"], ["o", "v"], "o", chunk_rows=2).filter("g = 1").orderBy("chunk").collect()
    assert [len(json.loads(c.payload)["rows"]) for c in chunks] == [2, 1]


def test_sinks(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    assert init_table(spark, ["a", "b"], path) == 0
    batch = spark.createDataFrame([(1, 2.5), (3, 4.0)], "x int, y double")
    assert append_rows(batch, path) == 2
    assert append_rows(batch.limit(0), path) == 0
    t = spark.read.parquet(path)
    assert t.columns == ["a", "b"] and sorted(r.a for r in t.collect()) == ["1", "3"]
    info = table_info(t, "a").collect()[0]
    assert (info.rows, info.updated) == (2, "2.5")
    assert clear_table(spark, path) == 0
    assert table_info(spark.read.parquet(path), "a").collect()[0].updated == "sin datos"
    assert refresh_table(batch, path) == 2
    n = write_tables({"one": batch, "two": batch.limit(1)}, os.path.join(tmpdir_path, "multi"))
    assert n == {"one": 2, "two": 1}


def test_read_delimited_skip_and_readers(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "plan.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("titulo\nversion 3\n\n")
        f.write("Region,Ergonomo,folios,Fecha Asistencia Tecnica TMERT 2026*\n")
        f.write("13.0,Ana,F1 || F2,04/03/2026\n7,,,\n")
    df = read_delimited_skip(spark, p, 3)
    assert df.columns[0] == "Region" and df.count() == 2
    q = os.path.join(tmpdir_path, "plan2.csv")
    with open(q, "w", encoding="utf-8") as f:
        f.write("Region,Ergonomo,folios,Fecha Asistencia Tecnica TMERT 2026*\n13.0,Ana,F1 || F2,04/03/2026\n")
    plan = read_plan(spark, q).collect()[0]
    assert plan.region == "13" and plan.has_case and plan.month == 3
    register(read_followup(spark, q), "fu_view")
    assert sql(spark, "SELECT count(*) AS n FROM fu_view").collect()[0].n == 1


def test_streaming_ingest_idempotent(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"b{i}.json"), "w") as f:
            f.write(json.dumps({"payload": json.dumps({"headers": ["k", "v"],
                                                       "rows": [[str(i), "a"], [str(i), "b"]]})}) + "\n")
    table = os.path.join(tmpdir_path, "table")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    q = start_payload_ingest(spark, src, table, ["k", "v"], ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 6
    q = start_payload_ingest(spark, src, table, ["k", "v"], ckpt)  # nothing new
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 6


def test_partitioned_refresh_prunes(spark, tmpdir_path):
    from visitlens.testing.registry import plan
    path = os.path.join(tmpdir_path, "plan_by_region")
    p = plan(spark, "/root/testdata/sf0.001").select("center_id", "region", "specialist")
    n = refresh_table(p, path, partition_by=["region"])
    t = spark.read.parquet(path).filter("region = '3'")
    plan_text = t._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan_text
    assert t.count() == p.filter("region = '3'").count() and n == p.count()


def test_read_delimited_skip_multi_split(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "big.csv")
    n = 60000
    with open(p, "w", encoding="utf-8") as f:
        f.write("preamble 1\npreamble 2\npreamble 3\n")
        f.write("id,label\n")
        for i in range(n):
            f.write(f"{i},label number {i} with some padding text\n")
    assert os.path.getsize(p) > 2_000_000
    df = read_delimited_skip(spark, p, 3)
    assert df.columns == ["id", "label"]
    got = df.selectExpr("count(*) AS c", "min(cast(id AS int)) AS lo", "max(cast(id AS int)) AS hi",
                        "count(DISTINCT id) AS d").collect()[0]
    assert (got.c, got.lo, got.hi, got.d) == (n, 0, n - 1, n)


def test_quoted_cells_and_missing_spellings(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "plan.csv")
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write("Region,Ergonomo,Nombre Empleador,folios,cie10,Fecha Asistencia Tecnica TMERT 2026*\n")
        f.write('13,Ana,"Taller ""El Sol"", Ltda",F1,"linea 1\nlinea 2",04/03/2026\nN/A,NA,,,null,\n')
    a, b = read_plan(spark, p).orderBy(F.col("region")).collect()
    assert (a.employer, a.case_ids, a.icd10, a.month) == ('Taller "El Sol", Ltda', "F1", "linea 1\nlinea 2", 3)
    assert (b.region, b.specialist, b.employer, b.icd10) == ("S/R", "No Asignado", None, "")
    with open(p, "a", encoding="utf-8") as f:
        f.write("1,2,3,4,5,6,7\n")
    assert [r.record for r in malformed_rows(spark, p).collect()] == ["1,2,3,4,5,6,7"]


def test_skip_every_file(spark, tmpdir_path):
    for n in (1, 2):
        with open(os.path.join(tmpdir_path, f"f{n}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(f'title "{n}\r\nline two\r\nid,label\r\n{n},"a ""b"", c\r\nd"\r\n\r\n{n}0,x\r\n')
    got = sorted(map(tuple, read_delimited_skip(spark, tmpdir_path, 2).collect()))
    assert got == [("1", 'a "b", c\nd'), ("10", "x"), ("2", 'a "b", c\nd'), ("20", "x")]


def newest_scratch(spark, name):
    from visitlens.session import checkpoint_dir
    tables = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    return max((os.path.join(tables, t) for t in os.listdir(tables) if t.startswith(name)), key=os.path.getmtime)


def test_delimited_skip_files_follow_rows(spark, tmpdir_path):
    """The query's files hold at most 10,000 rows each, however many rows there are."""
    from visitlens.testing.checks import q_delimited_skip
    n = 105_000
    spark.range(n).selectExpr("id AS c_custkey", "concat('name ', id) AS c_name").write.parquet(os.path.join(tmpdir_path, "customer.parquet"))
    out = q_delimited_skip(spark, tmpdir_path)
    assert len({r.file for r in read_lines(spark, f"{newest_scratch(spark, 'delimited_skip')}/file=*").select("file").distinct().collect()}) == 14
    got = out.selectExpr("count(*) AS c", "count(DISTINCT id) AS d", "min(id) AS lo", "max(id) AS hi",
                         "count_if(label = concat('name ', id, ' \"x\", a\nb')) AS same").first()
    assert tuple(got) == (n, n, 0, n - 1, n)


def test_payload_status(spark):
    good = '{"headers":["b","a"],"rows":[["1","2"]]}'
    data = [good, '{"headers":["a","b"],"rows":[["1"]]}', '{"headers":["a"', "", None, '{"rows":[["1"]]}', '{"headers":["a"],"rows":[["1"],["2"]]}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(data)], "id int, payload string")
    status = {r.id: (r.status, r.rows) for r in payload_status(df, keep=["id"]).collect()}
    assert status == {0: ("ok", 1), 1: ("error", 0), 2: ("error", 0), 3: ("error", 0), 4: ("error", 0), 5: ("ok", 1), 6: ("ok", 2)}
    rows = sorted((r.id, r.a, r.b) for r in payload_to_rows(df, ["a", "b"], keep=["id"]).collect())
    assert rows == [(0, "2", "1"), (5, "1", None), (6, "1", None), (6, "2", None)]


def records_of(text, quote='"', sep=","):
    """Records of a text, character by character; blank ones are left out."""
    out, record, state = [], "", "start"
    for i, c in enumerate(text):
        if c == "\n" and state != "quoted":
            out, record, state = out + [record], "", "start"
            continue
        record += c
        if state == "quoted":
            if c == quote:
                state = "quote"
        elif state == "quote" and c == quote:
            state = "quoted"
        elif c == sep:
            state = "start"
        else:
            state = "quoted" if c == quote and state == "start" else "text"
    return [r for r in out + [record] if r.strip(" ")]


def test_records_do_not_depend_on_the_splits(spark, tmpdir_path):
    rng = random.Random(4)
    parts = ["a", "b", ",", ",", '"', '""', "\n", "\n", '5" x', '"q"', '"m\nn"', "long " * 9]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for i, t in enumerate(texts):
        with open(os.path.join(tmpdir_path, f"f{i}.csv"), "w", newline="") as f:
            f.write('one "\n\n' + t)
    conf = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "0"}
    for size in ("5", "17", "64", "1m"):
        for k, v in conf.items():
            spark.conf.set(k, v or size)
        try:
            rows = cut_records(read_lines(spark, tmpdir_path), 2).orderBy("file", "number").collect()
        finally:
            for k in conf:
                spark.conf.unset(k)
        got = {}
        for r in rows:
            got.setdefault(int(r.file.rsplit("f", 1)[1][:-4]), []).append(r.record)
        assert all(got.get(i, []) == records_of(t) for i, t in enumerate(texts))


def test_long_cells_and_stray_quotes(spark, tmpdir_path):
    big = "y" * 10_000_000
    with open(os.path.join(tmpdir_path, "a.csv"), "w", newline="") as f:
        f.write(f'note\nid,label\n1,{big}\n2,5" pipe\n3,"{big}\n{big}"\n' + ",".join(["z" * 9] * 300) + "\n")
    with open(os.path.join(tmpdir_path, "b.csv"), "w", newline="") as f:
        f.write('note\nlabel,id,more\ntwo,4,x\n')
    df = read_delimited_skip(spark, tmpdir_path, 1)
    assert df.columns == ["id", "label", "more"]
    got = {r.id: (r.n, r.more, r.start) for r in df.selectExpr("id", "length(label) AS n", "more", "left(label, 7) AS start").collect()}
    assert got == {"1": (len(big), None, "y" * 7), "2": (7, None, '5" pipe'), "3": (2 * len(big) + 1, None, "y" * 7), "z" * 9: (9, None, "z" * 7), "4": (3, "x", "two")}


def test_empty_files(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "empty.csv")
    open(p, "w").close()
    assert read_followup(spark, p).count() == 0
    with pytest.raises(ValueError):
        read_delimited_skip(spark, p, 0)


def test_failed_refresh_leaves_the_table(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    refresh_table(spark.range(5), path)
    failing = spark.range(1000).select(F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        refresh_table(failing, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(5))
    assert refresh_table(spark.read.parquet(path).where("id > 1"), path) == 3  # from itself
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert os.listdir(tmpdir_path) == ["t"]


def test_appends_keep_the_order(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    init_table(spark, ["a", "b"], path, numbered=True)
    assert table_info(spark.read.parquet(path)).first().updated == "sin datos"
    names = [f"n{i}" for i in range(40)]
    for lot in (names[:25], [], names[25:]):
        rows = spark.createDataFrame([(x, i) for i, x in enumerate(lot)], "x string, y int").repartition(3).orderBy("y")
        assert append_rows(rows, path) == len(lot)
    assert [r.a for r in read_table(spark, path).collect()] == names
    assert [r._row for r in spark.read.parquet(path).orderBy("_row").collect()] == list(range(1, 41))
    assert tuple(table_info(spark.read.parquet(path)).first()) == (40, "n0")
    assert clear_table(spark, path) == 0 and append_rows(spark.createDataFrame([("z", 1)], "x string, y int"), path) == 1
    with pytest.raises(ValueError):
        table_info(spark.range(3))


def test_wide_rows_without_headers_are_reported(spark):
    df = spark.createDataFrame([(1, '{"rows":[["a"],["b","c","d","e"]]}'), (2, '{"rows":[["a"],["b","c"]]}')], "id int, payload string")
    assert [(r.status, r.error) for r in payload_status(df, columns=["x", "y"]).collect()] == [("error", "row wider than the table"), ("ok", None)]
    assert [(r.x, r.y) for r in payload_to_rows(df, ["x", "y"]).collect()] == [("a", None), ("b", "c")]


def test_stream_keeps_rejected_payloads(spark, tmpdir_path):
    src, table = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "table")
    os.makedirs(src)
    good, bad = '{"headers":["k"],"rows":[["1"],["2"]]}', '{"headers":["k"]'

    def put(name, payloads):
        with open(os.path.join(src, name), "w") as f:
            f.writelines(json.dumps({"payload": p}) + "\n" for p in payloads)

    def run(state):
        start_payload_ingest(spark, src, table, ["k"], os.path.join(tmpdir_path, state)).awaitTermination(120)
        log = spark.read.parquet(f"{table}_log")
        return spark.read.parquet(table).count(), sorted((r.status, r.payload) for r in log.collect())

    put("a.json", [good, bad])
    put("b.json", [bad])
    assert run("s1") == (2, [("error", bad), ("error", bad), ("ok", None)])
    put("c.json", [good])
    assert run("s2") == (4, [("error", bad), ("error", bad), ("ok", None), ("ok", None)])  # s1 was lost
    assert run("s2") == run("s1") == (4, [("error", bad), ("error", bad), ("ok", None), ("ok", None)])
