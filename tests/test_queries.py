"""Every registered query against its SQL counterpart in an independent engine."""

import pytest

import __spark_entry__ as entry
from compare import differences, sql_engine
from streamlake.plans import oracles as plans_oracles
from streamlake.plans import queries as plans_queries

ORACLES = plans_oracles.ORACLES
QUERIES = plans_queries.QUERIES
# Plan nodes no query may need: cross and nested-loop joins, Python, whole groups in one row.
UNWANTED = ["CartesianProduct", "NestedLoopJoin", "PythonUDF", "EvalPython", "InPandas",
            "collect_list", "collect_set"]


@pytest.fixture(scope="module")
def engine(sf_dir):
    return sql_engine(sf_dir)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, engine, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in UNWANTED if node in plan]
    assert differences(df, engine, ORACLES[name]) is None


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["window_start", "event_count"]
    assert df.count() > 0
