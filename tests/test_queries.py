"""Every query of the engine against its SQL."""

import pytest
from rowform import normal

from tidelog.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, duck, name):
    a, b = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert normal(a) == normal(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_predicates_reach_the_scan(spark, sf):
    from tidelog.operators import filters as L

    events = spark.read.parquet(f"{sf}/events.parquet").filter(L.key_range(__import__("pyspark").sql.functions.col("user_id"), 20, 90))
    plan = events.select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_id,20)" in plan and "PythonUDF" not in plan
