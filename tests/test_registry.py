"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import pytest
from check import compare, connect

import __spark_entry__ as spark_entry
from fleetpulse.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
QUERIES = spark_entry.queries()
ORACLES = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(catalog.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, duck.execute(ORACLES[name]).df()) is None


def test_flagship(spark):
    rows = spark_entry.entry(spark).collect()
    assert rows and {r.severity for r in rows} <= {"warning", "critical"}
