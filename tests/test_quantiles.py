import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.operators.quantiles import assign_quantile


def ntile(df, signal, n, by, tie):
    window = Window.partitionBy(*by).orderBy(F.col(signal).asc_nulls_first(), *tie)
    return df.withColumn("want", F.ntile(n).over(window))


def cross_sections(spark):
    """Dates of many sizes: below, at and above the group count, one huge, with ties and gaps."""
    rng = random.Random(5)
    rows = []
    for day, size in enumerate([1, 3, 9, 10, 11, 25, 99, 100, 101, 3000]):
        for i in range(size):
            kind = rng.random()
            signal = None if kind < 0.3 else 1.0 if kind < 0.6 else round(rng.gauss(0, 1), 2)
            rows.append((day, rng.randrange(10**9) * 4000 + i, signal))
    return spark.createDataFrame(rows, "day int, permno long, signal double").repartition(16)


@pytest.mark.parametrize("n", [2, 10])
def test_equals_ntile_with_ties_and_missing_signals(spark, n):
    df = cross_sections(spark)
    got = ntile(assign_quantile(df, "signal", n, ["day"]), "signal", n, ["day"], ["permno"])
    assert got.count() == df.count()
    assert got.where(~F.col("grp").eqNullSafe(F.col("want"))).count() == 0


def test_group_sizes_differ_by_at_most_one(spark):
    sizes = assign_quantile(cross_sections(spark), "signal", 10, ["day"]).groupBy("day", "grp").count()
    spread = sizes.groupBy("day").agg((F.max("count") - F.min("count")).alias("d")).agg(F.max("d")).first()[0]
    assert spread <= 1


def test_fewer_rows_than_groups(spark):
    df = spark.createDataFrame([(1, i, float(-i)) for i in range(3)], "day int, permno int, signal double")
    got = assign_quantile(df, "signal", 10, ["day"]).collect()
    assert {r["permno"]: r["grp"] for r in got} == {2: 1, 1: 2, 0: 3}


def test_missing_signals_can_be_dropped(spark):
    rows = [(1, 1, None), (1, 2, 5.0), (1, 3, 6.0), (1, 4, float("nan"))]
    df = spark.createDataFrame(rows, "day int, permno int, signal double")
    low = {r["permno"]: r["grp"] for r in assign_quantile(df, "signal", 2, ["day"]).collect()}
    assert low == {1: 1, 2: 1, 3: 2, 4: 2}
    kept = {r["permno"]: r["grp"] for r in assign_quantile(df, "signal", 2, ["day"], drop_missing=True).collect()}
    assert kept == {2: 1, 3: 2}


def test_rows_without_a_date_form_their_own_cross_section(spark):
    rows = [(None, 1, 1.0), (None, 2, 2.0), (7, 3, 9.0), (7, 4, 8.0)]
    df = spark.createDataFrame(rows, "day int, permno int, signal double")
    got = {r["permno"]: r["grp"] for r in assign_quantile(df, "signal", 2, ["day"]).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1}


def test_several_keys_and_tie_breaks(spark):
    rng = random.Random(9)
    rows = [(s, d, i, i % 7, float(rng.randrange(4))) for s in "ab" for d in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "sample string, day int, permno int, gvkey int, signal double")
    tie = ["gvkey", "permno"]
    got = ntile(assign_quantile(df, "signal", 5, ["sample", "day"], tie), "signal", 5, ["sample", "day"], tie)
    assert got.where("grp <> want").count() == 0


def test_no_window_holds_a_cross_section(spark):
    plan = assign_quantile(cross_sections(spark), "signal", 10, ["day"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan
