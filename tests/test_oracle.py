"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import os

import pytest

import __spark_entry__ as entry
from tests.conftest import ROOT, SMALL
from tests.oracle_compare import compare, duck_connection

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connection(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    res = compare(entry.queries()[name](spark, SMALL), SQL[name], con)
    assert res["ok"], res


def test_every_library_query_has_an_oracle():
    from marketlens.plans.registry import QUERIES
    assert set(QUERIES) <= set(SQL) <= set(entry.queries())


def test_oracle_imports_nothing_from_the_library():
    for name in ("queries.py", "tier_b.py", "mapping.py", "fixed_values.py"):
        with open(os.path.join(ROOT, "oracle", name), encoding="utf8") as f:
            assert "marketlens" not in f.read().replace("``marketlens``", "")


def test_requests_reach_every_intent(spark):
    got = entry.queries()["request_resolution"](spark, SMALL).collect()
    assert {r["intent"] for r in got} == {"competitor_tracking", "campaign_performance", "price_elasticity", "promotional_calendar"}
    assert {"no_such_report", "", None} <= {r["query_type"] for r in got} and {0, 100, 250, 500} == {r["row_limit"] for r in got}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "competitive_position" in df.columns
