"""Every registered query against its oracle on the smallest tables."""

import pytest

from planmark.plans import catalog
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_each_oracle_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    same, note = compare(spark, con, FOLDER, QUERIES[key], ORACLE.get(key))
    assert same, note
