"""Every registered query against its DuckDB oracle SQL (sf0.001)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import duck, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["rank", "name", "cnt", "pct", "pct_cum", "vital"]


def test_every_query_has_oracle():
    own = {k for k in E.queries() if not k.startswith("op") and k != "pipeline"}
    assert own <= set(SQL) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF).toPandas()
    exp = con.execute(SQL[key]).df()
    c1, r1 = rows_of(got)
    c2, r2 = rows_of(exp)
    assert c1 == c2
    assert r1 == r2
