"""Every query with SQL gives the SQL's rows."""

import pytest

from metaloam import catalogue
from tests.oracle import DATA, duck, spark_rows


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, name):
    assert spark_rows(catalogue.QUERIES[name](spark, DATA)) == duck(catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
