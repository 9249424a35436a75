"""Every query with SQL gives the SQL's rows over the smallest tables; the others run."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference
from wayfarer.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_and_sql(spark, con, name):
    assert difference(spark, con, SF, catalogue.queries()[name], catalogue.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
