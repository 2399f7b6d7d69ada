"""Every query of the core against SQL on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from conftest import DATA
from oracle import connection, rows
from shelfmark.plans import oracle, registry


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    found = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in oracle.SQL:
        assert len(found)
        return
    wanted = con.execute(oracle.SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
