"""Every query of the engine against its SQL."""

import pytest
from oracle import rows_of_duck, rows_of_spark

import __spark_entry__ as contract
from siftwork.plans import queries as engine


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows_of_spark(contract.queries()[name](spark, sf_dir)) == rows_of_duck(engine.oracle_sql()[name], sf_dir)


def test_entry_has_rows_and_a_stable_schema(spark, sf_dir):
    out = contract.entry(spark)
    assert out.columns == contract.entry(spark).columns
    assert out.count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_scans_have_no_shuffle_and_prune_columns(spark, sf_dir):
    plan = contract.queries()["rule_first_match"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan
