"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from workloads import check
from workloads.registry import QUERIES, SQL

# boosted trees of a whole grid train for many seconds; a single one is checked against SQL
SLOW = {"gbt_cv"}


@pytest.fixture(scope="module")
def con(sf):
    return check.duck(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, sf, con, name):
    ok, text = check.compare(spark, con, sf, QUERIES[name], SQL.get(name))
    assert ok, text


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
