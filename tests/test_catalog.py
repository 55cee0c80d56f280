import pytest

from conftest import DATA, rows_of
from tidemark.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_what_sql_gives(spark, duck, name):
    got = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    assert rows_of(got) == rows_of(duck.sql(ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["partition_prune"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in plan
