"""The registered queries of the operators that SQL can express, and the shape of the others."""

import pytest

import __spark_entry__
from check import compare, database
from seqloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_query_matches_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    assert compare(spark, database(SF), SF, name, df).startswith("ok")


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_quality_stays_native(spark):
    plan = queries.op6_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
