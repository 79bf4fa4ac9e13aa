"""Every query with SQL against DuckDB, and a check of the rest."""

import pytest

from blockalloc.jobs import registry
from conftest import values


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, data, duck, name):
    ours = registry.QUERIES[name](spark, data).toPandas()
    theirs = duck.execute(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert values(ours) == values(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows_and_repeats(spark, data, name):
    first = registry.QUERIES[name](spark, data).toPandas()
    assert len(first)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = registry.QUERIES[name](spark, data).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert values(first) == values(again), "the result depends on the number of partitions"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
