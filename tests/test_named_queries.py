"""Every named query against its SQL on the smallest tables; those without SQL give rows."""

import pytest

import __spark_entry__ as entry
from flowlark.plans import all_checks, all_queries
from tests.compare import checker, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: run for name, run in entry.queries().items() if name in all_queries()}
CHECKS = {name: sql for name, sql in entry.oracle_sql().items() if name in all_checks()}


@pytest.fixture(scope="module")
def con():
    return checker(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, CHECKS[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "src_ip"


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
