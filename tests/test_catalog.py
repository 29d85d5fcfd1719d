"""Every query against its SQL twin."""

import pytest

from sparktree import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(name, spark, oracle, same, data):
    found = catalog.QUERIES[name](spark, f"{data}/sf0.001").toPandas()
    same(found, oracle(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(name, spark, data):
    assert catalog.QUERIES[name](spark, f"{data}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
