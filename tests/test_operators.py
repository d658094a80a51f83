"""Operators on hand-written tables: expected outputs, guards and quirk pins."""

from pyspark.sql import functions as F

from visitlens.operators import aggregates as A
from visitlens.operators.cells import (atomic_values, cases_per_group, count_distinct_cases,
                                       multi_value_ranking, ranked)
from visitlens.operators.clean import clean_plan, type_followup
from visitlens.operators.filters import (apply_filters, contains_filter, facet_options,
                                         validate_selection)
from visitlens.operators.pareto import pareto_concentration, pareto_from_ranking

PLAN_HEADERS = ["Fecha Asistencia Tecnica TMERT 2026*", "Region", "Ergonomo", "Nombre Empleador",
                "folios", "tareas", "segmentos", "Comuna CT2",
                "N de trabajadores(as) a evaluar 2026 N hombres"]


def raw_plan(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in PLAN_HEADERS))


def test_clean_plan_defaults_and_quirks(spark):
    rows = [
        ("04-03-2026", "13.0", None, "E1", "F1 || F2", "soldar, pintar || cargar", "HOMBRO_DER", None, "12"),
        ("por definir", "10.05", "Ana", "E2", None, None, None, "Macul", "abc"),
        (None, None, None, None, None, None, None, None, None),  # all NULL
    ]
    # Q4: by default no row is dropped (the source drops after adding defaults)
    kept = clean_plan(raw_plan(spark, rows)).collect()
    assert len(kept) == 3 and sum(r.specialist == "No Asignado" for r in kept) == 2
    p = clean_plan(raw_plan(spark, rows), drop_empty=True).orderBy("employer").collect()
    assert len(p) == 2
    a, b = p
    assert a.planned_date.isoformat() == "2026-03-04" and a.month == 3 and a.month_name == "Marzo"
    assert a.region == "13" and a.specialist == "No Asignado" and a.account == "Sin Dato"
    assert a.has_case and a.commune == "S/D" and a.men == 12.0
    assert b.region == "105" and b.planned_date is None and b.men is None  # Q5, try_cast
    assert b.case_ids == "" and not b.has_case and b.commune == "Macul"


def test_clean_plan_missing_columns(spark):
    df = spark.createDataFrame([("E1",)], "`Nombre Empleador` string")
    r = clean_plan(df).collect()[0]
    assert r.region == "N/A" and r.specialist == "No Asignado" and r.tasks == "" and r.commune == "S/D"


def test_followup_typing_by_name(spark):
    cols = ["Ergonomo", "Región", "Meta 5 Cumplida", "Pilar 1 - Difusión",
            "Estado Seguimiento Prescripción Caracterización (sigeco)", "Fecha AT Difusión (real)", "_FechaCorte"]
    df = spark.createDataFrame([("A", "3.0", "verdadero ", "si", "2026-01-02", "02/03/2026", "2026-03-31")],
                               ", ".join(f"`{c}` string" for c in cols))
    r = type_followup(df).collect()[0]
    assert r.goal_met is True and r.pillar_1 is False and r.region == "3"
    assert r.prescription_followup_status == "2026-01-02"  # status text never parsed as a date
    assert r.diffusion_date.isoformat() == "2026-03-02" and r.cutoff_date.isoformat() == "2026-03-31"


def test_empty_followup(spark):
    df = spark.createDataFrame([], "Ergonomo string, `Meta 5 Cumplida` string")
    assert type_followup(df).count() == 0


def ranking_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "name string, cnt bigint")


def test_pareto_expected(spark):
    p = pareto_from_ranking(ranking_of(spark, {"a": 5, "b": 3, "c": 2})).orderBy("rank").collect()
    assert [(r.pct, r.pct_cum, r.vital) for r in p] == [(50.0, 50.0, True), (30.0, 80.0, True),
                                                       (20.0, 100.0, False)]
    one = pareto_from_ranking(ranking_of(spark, {"x": 7})).collect()[0]
    assert one.pct == 100.0 and one.vital is False


def test_pareto_keeps_top_and_ties_by_name(spark):
    r = ranking_of(spark, {f"n{i:02d}": 1 for i in range(40)})
    p = pareto_from_ranking(r, top=30).orderBy("rank").collect()
    assert len(p) == 30 and p[0].name == "n00" and p[-1].name == "n29"
    cum = [x.pct_cum for x in p]
    assert cum == sorted(cum)  # monotone


def test_pareto_requires_bound(spark):
    import pytest
    with pytest.raises(ValueError):
        pareto_from_ranking(ranking_of(spark, {"a": 1}), top=None)


def test_pareto_concentration(spark):
    p = pareto_from_ranking(ranking_of(spark, {"a": 5, "b": 3, "c": 2}))
    r = pareto_concentration(p).collect()[0]
    assert (r.n_vital, r.n_categories, r.pct_categories, r.cases_vital, r.pct_cases) == (2, 3, 66.7, 8, 80.0)


def test_multi_value_ranking_and_guards(spark):
    df = spark.createDataFrame([("SOLDADOR | PINTOR || OPERADOR", "HOMBRO_DER MANO_IZQ || LUMBAR"),
                                ("SOLDADOR", " "), ("", None)], "occupations string, segments string")
    occ = {r.name: r.cnt for r in multi_value_ranking(df, "occupations", " | ").collect()}
    assert occ == {"SOLDADOR": 2, "PINTOR": 1, "OPERADOR": 1}
    seg = {r.name: r.cnt for r in multi_value_ranking(df, "segments", ",", extra=[" "]).collect()}
    assert seg == {"HOMBRO_DER": 1, "MANO_IZQ": 1, "LUMBAR": 1}
    assert multi_value_ranking(df, "absent", ",").count() == 0
    top = ranked(multi_value_ranking(df, "occupations", " | "), 2).collect()
    assert [r.name for r in top] == ["SOLDADOR", "OPERADOR"]


def test_distinct_cases(spark):
    df = spark.createDataFrame([("F1 || F2", "E1"), ("F1||F1", "E2"), ("||", None), (" ", "E1")],
                               "case_ids string, employer string")
    assert count_distinct_cases(df).collect()[0].n_cases == 2
    assert count_distinct_cases(df, approx=True).collect()[0].n_cases == 2
    per = {r.employer: r.n_cases for r in cases_per_group(df, "employer").collect()}
    assert per == {"E1": 2, "E2": 1}


def test_atomic_values(spark):
    df = spark.createDataFrame([("Soldador | Pintor || soldador",), ("  Pintór ",), (None,)], "o string")
    assert sorted(r.value for r in atomic_values(df, "o", "||", "|").collect()) == ["pintor", "soldador"]


def test_filters_and_facets(spark):
    rows = [("A", "G1", "E1", "1"), ("A", "G2", "E2", "2"), ("B", "G1", "E3", "1"), (None, "G1", "E4", "2")]
    df = spark.createDataFrame(rows, "specialist string, account string, employer string, region string")
    assert apply_filters(df, {"specialist": "A", "account": None, "missing": "x"}).count() == 2
    opts = facet_options(df, {"specialist": "A", "account": "G1"}, ["specialist", "account", "region"])
    got = sorted((r.facet, r.value) for r in opts.collect())
    assert got == [("account", "G1"), ("account", "G2"), ("region", "1"), ("specialist", "A"), ("specialist", "B")]
    # every option keeps at least one row
    for f, v in got:
        sel = {"specialist": "A", "account": "G1"}
        sel[f] = v
        assert apply_filters(df, sel).count() > 0
    sel = validate_selection(df, {"specialist": "B", "account": "G2", "region": "1"},
                             ["specialist", "account", "region"])
    # checked in facet order: specialist first (no B/G2/1 row), then account, region survives
    assert sel == {"specialist": None, "account": None, "region": "1"}
    sel = validate_selection(df, {"specialist": "B", "account": "G1", "region": "2"},
                             ["specialist", "account", "region"])
    assert sel == {"specialist": None, "account": "G1", "region": "2"}


def test_contains_filter(spark):
    df = spark.createDataFrame([("MANO_DER",), ("mano",), ("CODO",)], "segments string")
    assert contains_filter(df, "segments", "MANO").count() == 2


def test_indicators_and_team(spark):
    rows = [("A", True, False, False, False, True), ("A", False, False, False, False, False),
            ("B", False, False, False, False, False), (None, True, True, True, True, True)]
    fu = spark.createDataFrame(rows, "specialist string, pillar_1 boolean, pillar_2 boolean, "
                                     "pillar_3 boolean, pillar_4 boolean, goal_met boolean")
    ind = {r.specialist: r for r in A.specialist_indicators(fu).collect()}
    assert set(ind) == {"A", "B"}  # NULL specialist dropped
    assert (ind["A"].pct_start, ind["A"].pct_goal, ind["A"].efficiency) == (50.0, 50.0, 100.0)
    assert ind["B"].efficiency == 0.0
    vs = {r.specialist: r.vs_team_pp for r in A.specialist_vs_team(fu.filter("specialist = 'A'"), fu).collect()}
    assert vs == {"A": 25.0}
    wide = A.pillar_wide(fu).filter("specialist = 'A'").collect()[0]
    assert wide["P1: Difusión"] == "1 (50.0%)"


def test_crosstab_fills_zero(spark):
    fu = spark.createDataFrame([("1", True), ("1", True), ("2", False)], "region string, goal_met boolean")
    got = {r.region: (r.n_false, r.n_true) for r in A.crosstab_flag(fu).collect()}
    assert got == {"1": (0, 2), "2": (1, 0)}


def test_kpis_empty_followup(spark):
    plan = spark.createDataFrame([("2026-01-01", 1, True, "E1", "F1")],
                                 "planned_date string, month int, has_case boolean, employer string, case_ids string")
    plan = plan.withColumn("planned_date", F.to_date("planned_date"))
    fu = spark.createDataFrame([], "goal_met boolean, visit_status string")
    r = A.kpi_global(plan, fu).collect()[0]
    assert r.scheduled == 1 and r.goals_met is None and r.n_cases == 1 and r.employers_with_cases == 1
    k = A.kpi_followup(plan.limit(0), fu).collect()[0]
    assert k.universe == 0 and k.progress_pct == 0.0 and k.pillar_1_pct == 0.0


def test_headers_trimmed_before_alias_rename(spark):
    # Q12: " Region " is trimmed first, then renamed to the accented header
    df = spark.createDataFrame([("7.0", "x")], "` Region ` string, `Nombre Empleador ` string")
    r = clean_plan(df).collect()[0]
    assert r.region == "7" and r.employer == "x"


def test_month_filter_population_q8(spark):
    # Q8: the month filter narrows the scheduled plan only; goals come from the whole follow-up
    plan = spark.createDataFrame([("2026-01-05", 1, False, "E", ""), ("2026-02-05", 2, False, "E", "")],
                                 "d string, month int, has_case boolean, employer string, case_ids string")
    plan = plan.withColumn("planned_date", F.to_date("d")).drop("d")
    fu = spark.createDataFrame([(True, "x"), (True, "y")], "goal_met boolean, visit_status string")
    r = A.kpi_global(plan, fu, month=1).collect()[0]
    assert (r.scheduled, r.goals_met, r.goal_pct) == (1, 2, 200.0)
