"""Every registered query beside its SQL at the smallest scale."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_sql(spark, con, name):
    status, _, _, note = check.compare(spark, con, SF, queries()[name], oracle_sql().get(name))
    assert status in ("ok", "rows"), note


def test_entry_has_one_row_per_host(spark):
    df = entry(spark)
    assert df.count() == df.select("host").distinct().count() > 0


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())
