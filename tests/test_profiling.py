import pytest
from pyspark.sql import functions as F

from panelforge.operators import profiling


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [(1, 0.5, "a"), (2, None, "b"), (3, 0.5, "a"), (4, -1.0, None)], "permno int, ret double, industry string"
    ).withColumn("date", F.to_date(F.lit("2000-01-31")))


def test_null_counts(table):
    got = {r["column"]: (r["rows"], r["nulls"]) for r in profiling.null_counts(table, ["ret", "industry", "permno"]).collect()}
    assert got == {"ret": (4, 1), "industry": (4, 1), "permno": (4, 0)}


def test_summary_is_what_describe_says(table):
    got = {r["column"]: r for r in profiling.summary(table, ["ret", "permno"]).collect()}
    want = {r["summary"]: r for r in table.describe("ret", "permno").collect()}
    for column in ("ret", "permno"):
        for name in ("count", "mean", "stddev", "min", "max"):
            assert float(got[column][name]) == pytest.approx(float(want[name][column]))


def test_distinct_values(table):
    assert {r[0] for r in profiling.distinct_values(table, ["industry"]).collect()} == {"a", "b", None}


def test_top_returns_break_ties_by_security(table):
    assert [r["permno"] for r in profiling.top_returns(table, 2).collect()] == [1, 3]
    assert [r["permno"] for r in profiling.top_returns(table, 50).collect()] == [1, 3, 4, 2]
    plan = profiling.top_returns(table)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_lookup_by_table(table, spark):
    ids = spark.createDataFrame([(2,), (4,), (4,)], "permno int")
    assert sorted(r["permno"] for r in profiling.securities(table, ids, ["permno"]).collect()) == [2, 4]


def test_summary_of_dates_and_text_counts_them(spark):
    df = spark.sql("SELECT date'2000-01-01' AS date, 'x' AS name, 2.0D AS ret")
    got = {r["column"]: (r["count"], r["mean"], r["max"]) for r in profiling.summary(df, ["date", "name", "ret"]).collect()}
    assert got == {"date": (1, None, None), "name": (1, None, None), "ret": (1, 2.0, 2.0)}
