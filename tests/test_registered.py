"""Every registered query against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, line = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, line


def test_entry_reports_worst_first(spark):
    rows = entry.entry(spark).collect()
    percents = [r["deviation_pct"] for r in rows]
    assert rows and percents == sorted(percents, reverse=True) and percents[-1] > 15 - 0.05
