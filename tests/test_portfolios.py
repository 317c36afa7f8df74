import math
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.operators import performance, portfolios
from panelforge.plans import backtest
from tests.conftest import column


def monthly(spark, returns, start=0, **extra):
    rows = [(2000 + (start + i) // 12, (start + i) % 12 + 1, r, *extra.values()) for i, r in enumerate(returns)]
    types = "".join(f", {k} {'int' if isinstance(v, int) else 'string'}" for k, v in extra.items())
    return spark.createDataFrame(rows, f"year int, month int, ret double{types}")


def test_portfolio_returns_by_hand(spark):
    rows = [(1, 0.1, 0.09, 10.0, 100.0), (1, 0.2, 0.19, 30.0, 100.0), (2, -0.1, None, None, 100.0)]
    df = spark.createDataFrame(rows, "grp int, ret double, ex_ret double, size double, total_mktcap double").selectExpr(
        "*", "2000 AS year", "1 AS month", "size / total_mktcap AS weight_mktcap"
    )
    got = {r["grp"]: r for r in portfolios.portfolio_returns(df, "ex_ret").collect()}
    assert got[1]["equal_ret"] == pytest.approx(0.14)
    assert got[1]["value_ret"] == pytest.approx((0.1 * 10 + 0.2 * 30) / 40)
    assert got[2]["equal_ret"] is None and got[2]["value_ret"] is None
    assert {r["grp"]: r["equal_ret"] for r in portfolios.portfolio_returns(df).collect()}[1] == pytest.approx(0.15)


def test_wealth_skips_missing_returns(spark):
    df = portfolios.cumulative_return(monthly(spark, [None, 0.1, None, 0.2], grp=1), "ret")
    got = column(df, "wealth", "year", "month")
    assert got[0] is None and got[2] is None
    assert got[1] == pytest.approx(1.1) and got[3] == pytest.approx(1.32)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-0.99, 2.0)), min_size=1, max_size=30))
def test_last_wealth_is_the_product_of_returns(spark, returns):
    df = monthly(spark, returns, grp=1)
    path = [w for w in column(portfolios.cumulative_return(df, "ret"), "wealth", "year", "month") if w is not None]
    known = [1 + r for r in returns if r is not None]
    assert len(path) == len(known)
    if known:
        assert path[-1] == pytest.approx(math.prod(known), rel=1e-9)
        end = portfolios.terminal_wealth(df, {"all": ("1999-12-31", "2099-12-31")}, "ret").first()["wealth"]
        assert end == pytest.approx(path[-1], rel=1e-9)


def test_subsamples_start_after_their_date(spark):
    df = monthly(spark, [0.1, 0.1, 0.1, 0.1], grp=1)
    got = portfolios.sample_paths(df, {"full": None, "out": "2000-02-29", "recent": "2000-04-01"}, "ret", ["grp"])
    wealth = {(r["sample"], r["month"]): round(r["wealth"], 6) for r in got.collect()}
    assert wealth == {
        ("full", 1): 1.1, ("full", 2): 1.21, ("full", 3): 1.331, ("full", 4): 1.4641,
        ("out", 3): 1.1, ("out", 4): 1.21, ("recent", 4): 1.1,
    }


def test_terminal_wealth_per_period(spark):
    df = monthly(spark, [0.1, 0.2, 0.3], grp=1)
    got = portfolios.terminal_wealth(df, {"a": ("1999-12-31", "2000-02-29"), "b": ("2000-02-29", "2000-12-31")}, "ret")
    assert {r["period"]: round(r["wealth"], 6) for r in got.collect()} == {"a": 1.32, "b": 1.3}


def test_matrix_has_a_column_per_group(spark):
    df = monthly(spark, [0.1], grp=1).unionByName(monthly(spark, [0.3], grp=3))
    row = portfolios.to_matrix(df, "ret", 3).first()
    assert (row["g1"], row["g2"], row["g3"]) == (0.1, None, 0.3)


def test_market_value_is_not_rescaled(spark):
    df = spark.createDataFrame([(2000, 1, 0.1, 0.2), (2000, 1, 0.3, 0.3), (2000, 1, 0.5, None)], "year int, month int, ret double, weight_mktcap double")
    assert portfolios.market_value(df).first()["ret"] == pytest.approx(0.11)
    assert portfolios.market_equal(df).first()["ret"] == pytest.approx(0.3)


def test_performance(spark):
    returns = [0.01, 0.03, -0.02, None]
    row = performance.performance_stats(monthly(spark, returns, grp=1), "ret").first()
    known = returns[:3]
    annual, volatility = statistics.mean(known) * 12, statistics.stdev(known) * math.sqrt(12)
    assert row["annual_return"] == pytest.approx(annual)
    assert row["annual_volatility"] == pytest.approx(volatility)
    assert row["sharpe"] == pytest.approx(annual / volatility)
    flat = performance.performance_stats(monthly(spark, [0.5, 0.5], grp=1), "ret").first()
    assert flat["sharpe"] is None


def test_legs_align_by_month(spark):
    a = monthly(spark, [0.1, 0.2], grp=10).withColumn("signal", F.lit("x"))
    b = monthly(spark, [0.3, 0.4], start=1, grp=1).withColumn("signal", F.lit("y"))
    returns = a.unionByName(b)
    picked = performance.pick_legs(returns, {"a": ("x", 10), "b": ("y", 1), "again": ("x", 10), "c": ("x", 9)}, "ret")
    got = performance.compare_legs(picked, ["a", "b", "again", "c"]).orderBy("year", "month").collect()
    assert [(r["month"], r["a"], r["b"], r["again"], r["c"]) for r in got] == [
        (1, 0.1, None, 0.1, None), (2, 0.2, 0.3, 0.2, None), (3, None, 0.4, None, None),
    ]


def test_signals_sorted_together_equal_signals_sorted_alone(spark):
    import random

    rng = random.Random(4)
    rows = [(m, p, rng.gauss(0, 1), rng.choice([None, 1.0, 2.0]), rng.gauss(0, 0.1), rng.uniform(1, 9)) for m in (1, 2) for p in range(31)]
    df = spark.createDataFrame(rows, "month int, permno int, x double, y double, ret double, size double").selectExpr(
        "*", "2000 AS year", "last_day(make_date(2000, month, 1)) AS date", "100.0D AS total_mktcap",
        "size / 100 AS weight_mktcap", "ret - 0.01 AS ex_ret",
    )
    both = backtest.sorted_portfolios(df, ["x", "y", "size"], 5, ["permno"])
    alone = [backtest.sorted_portfolios(df, [s], 5, ["permno"]) for s in ("x", "y", "size")]

    def table(*parts):
        return {(r["signal"], r["grp"], r["month"]): (r["equal_ret"], r["value_ret"]) for p in parts for r in p.collect()}

    got, want = table(both), table(*alone)
    assert got.keys() == want.keys() and len(got) == 30
    for key in want:
        assert got[key] == pytest.approx(want[key])


def test_back_test_against_plain_python(spark):
    import random

    rng = random.Random(3)
    rows = [
        (m, p, rng.gauss(0, 1), rng.gauss(0, 0.1), rng.uniform(1, 9))
        for m in (1, 2, 3) for p in range(23)
    ]
    total = {m: sum(r[4] for r in rows if r[0] == m) for m in (1, 2, 3)}
    df = spark.createDataFrame(
        [(p, m, x, r, s, total[m]) for m, p, x, r, s in rows],
        "permno int, month int, prediction double, ret double, size double, total_mktcap double",
    ).selectExpr("*", "2000 AS year", "last_day(make_date(2000, month, 1)) AS date", "size / total_mktcap AS weight_mktcap")
    result = backtest.back_test(df, n=5, tie_break=["permno"])
    want = {}
    for m in (1, 2, 3):
        ordered = sorted((x, p, r, s) for mm, p, x, r, s in rows if mm == m)
        at = 0
        for g in range(1, 6):
            size = 23 // 5 + (g <= 23 % 5)
            part = ordered[at : at + size]
            at += size
            value = sum(r * s for _, _, r, s in part) / sum(s for *_, s in part)
            want[m, g] = (statistics.mean(r for _, _, r, _ in part), value, statistics.mean(x for x, *_ in part))
    got = {(r["month"], r["grp"]): r for r in result["returns"].collect()}
    assert got.keys() == want.keys()
    for key, (equal, value, _) in want.items():
        assert got[key]["equal_ret"] == pytest.approx(equal) and got[key]["value_ret"] == pytest.approx(value)
    for r in result["prediction"].collect():
        assert r["prediction"] == pytest.approx(want[r["date"].month, r["grp"]][2])
    last = {(r["weighting"], r["grp"]): r["wealth"] for r in result["wealth"].where("month = 3").collect()}
    for g in range(1, 6):
        for i, weighting in enumerate(("equal", "value")):
            assert last[weighting, g] == pytest.approx(math.prod(1 + want[m, g][i] for m in (1, 2, 3)))
    assert result["equal"].orderBy("month").first()["g2"] == pytest.approx(want[1, 2][0])
    assert result["value"].orderBy("month").first()["g5"] == pytest.approx(want[1, 5][1])
