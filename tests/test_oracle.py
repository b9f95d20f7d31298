"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry
from seqloom.plans import queries
from seqloom.plans import sql as oracle_sql
from check import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    df = queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name in oracle_sql():
        want = {r[0]: r[1] for r in con.execute("DESCRIBE " + oracle_sql()[name]).fetchall()}
        assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == want
    assert compare(spark, con, SF, name, df).startswith(("ok", "no sql"))


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    result = entry(spark)
    assert [r["metric"] for r in result.orderBy("metric").collect()] == ["ndcg@10", "ndcg@5", "recall@10", "recall@5"]
