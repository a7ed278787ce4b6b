"""Every named query against its SQL counterpart, over whole given tables."""

from __future__ import annotations

import pytest
from compare import differences, duck

import __spark_entry__ as contract
from retail_engine.plans import catalogue, oracle

SMALL = "/root/testdata/sf0.001"
# Revenue, units, orders and average of the given tables, as listed in FIXTURES.md.
GOLDEN = {
    "0.001": (317364757.31, 152257, 1473, 215454.68928038017),
    "0.01": (3183256271.63, 1524135, 14743, 215916.4533426033),
    "0.1": (31771202123.6, 15300431, 147236, 215784.1976391643),
}


@pytest.fixture(scope="module")
def sql():
    return duck(SMALL)


def test_every_query_has_a_counterpart():
    assert set(catalogue.queries()) == set(oracle.oracle_sql())
    assert set(catalogue.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, sql, name):
    found = contract.queries()[name](spark, SMALL)
    assert differences(found, sql, contract.oracle_sql()[name]) is None


@pytest.mark.parametrize("scale", GOLDEN)
def test_summary_totals(spark, scale):
    row = contract.queries()["revenue_summary"](spark, f"/root/testdata/sf{scale}").first()
    assert tuple(row) == GOLDEN[scale]


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 149
    assert [r.totalRevenue for r in rows] == sorted((r.totalRevenue for r in rows), reverse=True)
