"""Pages from one scan, whole-token drill-down, bounds of the facet validation."""

import os

import pytest
from pyspark.sql import functions as F

from visitlens.operators import aggregates as A
from visitlens.operators.filters import MAX_CHOSEN, token_filter, validate_selection
from visitlens.plans import reports as R
from visitlens.sources.sinks import refresh_table
from visitlens.testing.registry import followup, plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sheets(spark, tmp_path_factory):
    """The typed plan and follow-up as tables of their own, so that scans can be counted."""
    base = str(tmp_path_factory.mktemp("sheets"))
    for name, df in (("plan", plan(spark, SF)), ("fu", followup(spark, SF))):
        refresh_table(df, os.path.join(base, name))
    return spark.read.parquet(os.path.join(base, "plan")), spark.read.parquet(os.path.join(base, "fu"))


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_one_scan_a_table(sheets):
    p, fu = sheets
    assert scans(A.kpi_global(p, fu)) == scans(A.kpi_followup(p, fu)) == 2
    assert scans(A.case_summary(p)) == 1
    pages = [R.programme_page(p, {}), R.followup_page(p, fu, {}), R.indicators_page(fu, {}), R.case_page(p, {}), R.drill_page(p, {})]
    for page in pages:
        for name, table in page.items():
            assert scans(table) == (1 if name in ("visit_detail", "detail", "records") else 0), name


def test_pages_equal_single_operators(sheets):
    p, fu = sheets
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    sel = {"account": "MACHINERY"}
    f, q = fu.filter("account = 'MACHINERY'"), p.filter("account = 'MACHINERY'")
    ind, prog = R.indicators_page(fu, sel), R.programme_page(p, sel, month=3)
    assert rows(ind["pillar_long"]) == rows(A.pillar_progress(f)) and rows(ind["pillar_wide"]) == rows(A.pillar_wide(f))
    assert rows(ind["team_mean"]) == rows(A.team_mean(A.specialist_indicators(fu)))
    assert rows(ind["indicators"]) == rows(A.specialist_vs_team(f, fu))
    assert rows(prog["worker_totals"]) == rows(A.worker_totals(q.filter("month = 3")))
    assert rows(R.followup_page(p, fu, sel)["kpi_global"]) == rows(A.kpi_global(q, f))
    empty = R.case_page(p.limit(0), {})
    assert rows(empty["summary"]) == [(0, 0, 0)] and empty["pareto"].count() == 0
    assert rows(R.programme_page(p.limit(0), {})["worker_totals"]) == [(0, 0, 0)]


def test_visit_table_is_sorted_and_labelled(sheets):
    t = R.visit_table(sheets[0].filter(F.col("planned_date").isNotNull()))
    assert t.columns[:5] == ["Fecha", "Region", "Ergónomo", "Nombre Empleador", "Centro de Trabajo"]
    dates = [tuple(reversed(r.Fecha.split("-"))) for r in t.collect()]
    assert dates == sorted(dates)


def test_whole_tokens(spark):
    df = spark.createDataFrame([(1, "MANO_DER CODO"), (2, "MANO"), (3, "codo || mano"), (4, None), (5, "")], "id int, segments string")
    assert [r.id for r in token_filter(df, "segments", " mano ").collect()] == [2, 3]
    assert token_filter(df, "segments", None).count() == 5


def test_facets_validated_together_are_bounded(spark):
    names = [f"f{i}" for i in range(MAX_CHOSEN + 1)]
    df = spark.createDataFrame([("x",) * len(names)], ", ".join(f"{n} string" for n in names))
    with pytest.raises(ValueError):
        validate_selection(df, dict.fromkeys(names, "x"), names)
    assert validate_selection(df, dict.fromkeys(names[:4], "x"), names) == dict.fromkeys(names[:4], "x") | dict.fromkeys(names[4:])


def test_index_equals_direct_answers(spark, sheets, tmp_path):
    from visitlens.operators.case_index import CaseIndex, build_case_index
    from visitlens.operators.cells import cases_per_group
    from visitlens.operators.filters import apply_filters, facet_options, only_cases
    p, fu = sheets
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    built = build_case_index(p, fu, str(tmp_path))
    assert built["combos"] <= p.count() and set(built) == {"cases", "combos", "bits", "followup"}
    index = CaseIndex(spark, str(tmp_path))
    some = p.filter("has_case").first()
    for sel in ({}, {"account": "MACHINERY"}, {"region": "3", "specialist": some.specialist}, {"employer": some.employer}, {"holding": "none such"}):
        q, f = apply_filters(p, sel), apply_filters(fu, sel)
        for month in (None, 3):
            assert rows(index.kpi_global(sel, month)) == rows(A.kpi_global(q, f, month))
            assert rows(index.kpi_followup(sel, month)) == rows(A.kpi_followup(q, f, month))
        assert rows(index.case_summary(sel)) == rows(A.case_summary(only_cases(q)))
        assert rows(index.cases_by("employer", sel)) == rows(cases_per_group(q, "employer"))
        assert rows(index.facet_options(sel)) == rows(facet_options(p, sel))
    build_case_index(p.limit(0), fu.limit(0), str(tmp_path / "none"))
    assert rows(CaseIndex(spark, str(tmp_path / "none")).kpi_global({})) == [(0, None, None, 0, 0)]
