"""The registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as registry
from catalog.check import compare

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 90


def test_flagship(spark):
    rows = registry.entry(spark).collect()
    assert rows and abs(sum(r["percent"] for r in rows) - 100) < 1e-3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    good, note = compare(spark, data, name, QUERIES[name], SQL.get(name))
    assert good, note
