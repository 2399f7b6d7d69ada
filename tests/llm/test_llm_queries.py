"""Queries of the subpackage against SQL, or for their bounds, on the smallest test tables."""

import pytest

from conftest import DATA
from oracle import connection, rows
from shelfmark.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, DATA).toPandas()
    if name in oracle.SQL:
        wanted = connection(DATA).execute(oracle.SQL[name]).df()
        assert rows(found) == rows(wanted)
    assert not found.duplicated().any()


def test_fill(spark):
    for r in queries.p6_fill(spark, DATA).collect():
        capacity = {1: 512, 2: 2048, 3: 8192}[r.capacity_id]
        assert r.fullest <= capacity and r.containers <= r.tokens / capacity * 1.01 + 1
