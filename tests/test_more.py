"""Lookups, schema helpers, flag sums and report compositions."""

from pyspark.sql import functions as F

from visitlens.operators import aggregates as A
from visitlens.operators.lookup import anti_membership, lookup, semi_membership
from visitlens.operators.shape import (ensure_columns, match_columns, relabel, rename_headers,
                                       select_existing, strip_headers)
from visitlens.plans import reports as R
from visitlens.testing.registry import followup, plan

SF = "/root/testdata/sf0.001"


def test_lookup_and_membership(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    m = spark.createDataFrame([("a", "A")], "key string, val string")
    got = sorted((r.k or "", r.v or "") for r in lookup(df, "k", m, "key", "val", out="v").collect())
    assert got == [("", ""), ("a", "A"), ("b", "b")]
    assert [r.k for r in anti_membership(df.na.drop(), "k", m, "key").collect()] == ["b"]
    assert [r.k for r in semi_membership(df, "k", m, "key").collect()] == ["a"]


def test_shape_helpers(spark):
    df = spark.createDataFrame([(" x", None)], "` a ` string, b string")
    df = strip_headers(df)
    assert df.columns == ["a", "b"]
    df = ensure_columns(df, {"b": "def", "c": "new"})
    r = df.collect()[0]
    assert (r.b, r.c) == ("def", "new")
    assert select_existing(df, ["c", "zz", "a"], insert=(1, "b")).columns == ["c", "b", "a"]
    assert relabel(df, {"a": "A", "q": "Q"}).columns == ["A", "b", "c"]
    assert rename_headers(df, {"Region": "Región"}).columns == df.columns
    assert match_columns(spark.createDataFrame([], "`Fecha X` string, `Pilar Fecha` string, y string"),
                         ["Fecha"], ["Pilar"]) == ["Fecha X"]


def test_flag_sums_and_counts(spark):
    df = spark.createDataFrame([(True, None, "E1"), (False, True, "E1"), (True, True, None)],
                               "p1 boolean, p2 boolean, employer string")
    r = A.flag_sum(df, ["p1", "p2"], denominator=4).collect()[0]
    assert (r.p1_n, r.p2_n, r.p1_pct, r.p2_pct) == (2, 2, 50.0, 50.0)
    assert A.distinct_count(df, "employer").collect()[0][0] == 1
    assert A.row_count(df).collect()[0][0] == 3


def test_reports_compose(spark):
    p, f = plan(spark, SF), followup(spark, SF)
    sel = {"specialist": None, "account": "MACHINERY"}
    pages = [R.programme_page(p, sel), R.followup_page(p, f, sel), R.indicators_page(f, sel),
             R.case_page(p, sel, segment="LUMBAR", dimension="tasks"), R.drill_page(p, sel, "diagnoses", "Brand#2"),
             R.pareto_drill_page(p, sel, "MANO_DER"), {"sheet": R.plan_sheet(p)}]
    empty = {"segment_options"} if not p.filter("has_case").limit(1).count() else set()
    for page in pages:
        for name, df in page.items():
            assert name in empty or df.count() > 0, name
    d = R.visit_detail(p.filter(F.col("planned_date").isNotNull()), sort=True).limit(50).collect()
    dates = [tuple(reversed(x.date_text.split("-"))) for x in d]
    assert dates == sorted(dates)
    ind = [r.pct_goal for r in R.indicators_page(f, sel)["indicators"].collect()]
    assert ind == sorted(ind, reverse=True)
    mean = R.indicators_page(f, {})["team_mean"].collect()[0]
    assert 0 <= mean.team_mean_pct <= 100


def test_non_blank_and_proposal_order(spark):
    from visitlens.operators.filters import non_blank
    from visitlens.operators.similarity_join import propose
    df = spark.createDataFrame([("a",), (" ",), (None,), ("　",)], "c string")
    assert [r.c for r in non_blank(df, "c").collect()] == ["a"]
    vocab = spark.createDataFrame([(v,) for v in ["soldador", "soldadores", "soldadore", "pintor", "pintora"]],
                                  "value string")
    rows = [(r.canonical, r.similarity) for r in propose(vocab).collect()]
    assert rows == sorted(rows, key=lambda x: (x[0], -x[1]))
    assert {c for c, _ in rows} == {"pintora", "soldadores"}  # pintor~pintora = 92.3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kpi_plans(spark):
    p, f = plan(spark, SF), followup(spark, SF)
    assert "Generate" not in plan_of(A.kpi_followup(p, f))
    for df in (A.kpi_global(p, f), A.case_summary(p)):
        assert "Expand" not in plan_of(df)


def test_filters_reach_the_scan(spark, tmpdir_path):
    from visitlens.operators.filters import apply_filters
    path = f"{tmpdir_path}/typed"
    plan(spark, SF).select("center_id", "region", "specialist").write.parquet(path)
    text = plan_of(apply_filters(spark.read.parquet(path), {"region": "3", "specialist": None}))
    assert "PushedFilters: [IsNotNull(region), EqualTo(region,3)]" in text
