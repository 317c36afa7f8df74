import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelforge.operators import signals
from tests.conftest import column


def compounded(returns):
    kept = [r for r in returns if r is not None and r > -1]
    return math.prod(1 + r for r in kept) - 1 if kept else None


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w or (g is not None and w is not None and g == pytest.approx(w, abs=1e-12)), (got, want)


RETURNS = [0.1, -0.2, None, 0.05, -1.0, 0.3, 0.0, 0.02, -0.07, 0.11, 0.2, -0.01, 0.04, 0.09, -0.3, 0.06]


def test_momentum_frames_are_row_based_and_partial(months):
    df = signals.momentum(months(RETURNS))
    for name, far in signals.MOMENTUM_FRAMES.items():
        want = [compounded(RETURNS[max(0, i - far) : max(0, i - 1)]) for i in range(len(RETURNS))]
        close(column(df, name), want)


def test_total_loss_is_left_out_of_momentum(months):
    df = signals.momentum(months([0.1, -1.0, 0.2, 0.0, 0.0]), {"m": 12})
    assert column(df, "m")[4] == pytest.approx(1.1 * 1.2 - 1)


def test_a_missing_month_is_skipped_over(months):
    gap = months([0.1, 0.2, 0.3, 0.4]).where("date <> date'2000-02-29'")
    assert column(signals.reversal(gap), "reversal") == [None, 0.1, 0.3]


def test_min_obs_is_off_by_default_and_can_be_asked_for(months):
    df = months([0.1, 0.2, 0.3, 0.4, 0.5])
    assert column(signals.momentum(df, {"m": 12}), "m")[2] is not None
    strict = column(signals.momentum(df, {"m": 12}, min_obs=3), "m")
    assert strict[3] is None and strict[4] is not None


def test_momentum_count_takes_missing_as_losing(months):
    returns = [0.1, None, -0.1, 0.0, 0.2, 0.3]
    assert column(signals.momentum_count(months(returns)), "momentum_count") == [None, None, 1, 1, 1, 2]


def test_liquidity(months):
    df = months([0.0] * 3, prc=[10.0, 20.0, 5.0], vol=[2.0, 0.0, 4.0], shrout=[4.0, 2.0, 0.0])
    close(column(signals.dollar_volume(df), "dvol"), [None, math.log(20.0), None])
    close(column(signals.turnover(df), "turn"), [None, math.log(0.5), None])


def test_factors_keep_every_panel_row(spark, months):
    panel = months([0.1, 0.2]).selectExpr("*", "year(date) AS year", "month(date) AS month")
    factors = spark.createDataFrame([(2000, 1, 0.02, 0.001, 0.021)], "year int, month int, mkt_rf double, rf double, mkt double")
    df = signals.excess_return(signals.join_factors(panel, factors))
    close(column(df, "ex_ret"), [0.099, None])


def pearson(xs, ys):
    pairs = [(x, y) for x, y in zip(xs, ys) if x is not None and y is not None]
    if len(pairs) < 2:
        return None
    xs, ys = zip(*pairs)
    if len(set(xs)) == 1 or len(set(ys)) == 1:
        return None
    return statistics.correlation(xs, ys)


def test_correlation_is_pairwise_and_survives_constants(months):
    stock = [0.1, None, 0.3, -0.2, 0.1, 0.4]
    market = [0.02, 0.01, None, 0.03, -0.01, 0.02]
    df = months([0.0] * 6, ex_ret=stock, mkt_rf=market)
    want = [pearson(stock[max(0, i - 3) : i + 1], market[max(0, i - 3) : i + 1]) for i in range(6)]
    close(column(signals.rolling_corr(df, 4), "corr"), want)
    flat = months([0.0] * 3, ex_ret=[0.1, 0.2, 0.3], mkt_rf=[0.5] * 3)
    assert column(signals.rolling_corr(flat), "corr") == [None] * 3


def test_beta_and_its_lags(months):
    stock = [0.1, -0.1, 0.3, -0.2, 0.1]
    market = [0.02, 0.01, -0.03, 0.03, -0.01]
    df = signals.beta(months([0.0] * 5, ex_ret=stock, mkt_rf=market), vol_n=3, corr_n=4)
    beta = []
    for i in range(5):
        c = pearson(stock[max(0, i - 3) : i + 1], market[max(0, i - 3) : i + 1])
        s, m = stock[max(0, i - 2) : i + 1], market[max(0, i - 2) : i + 1]
        beta.append(None if c is None else c * statistics.stdev(s) / statistics.stdev(m))
    shrunk = [None if b is None else 0.6 * b + 0.4 for b in beta]
    close(column(df, "beta"), beta)
    close(column(df, "beta_lag"), [None, *beta[:-1]])
    close(column(df, "beta_shrink_lag"), [None, *shrunk[:-1]])
    close(column(df, "beta_lag_square"), [None if b is None else b * b for b in [None, *beta[:-1]]])


def test_weights_sum_to_one_per_date(spark):
    rows = [(i, i % 3, float(1 + i * i)) for i in range(50)] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "permno int, d int, size double").selectExpr(
        "permno", "date_add(date'2000-01-01', d) AS date", "size"
    )
    weighted = signals.value_weights(df)
    assert weighted.count() == 51
    sums = weighted.groupBy("date").agg(F.sum("weight_mktcap")).collect()
    assert [r[1] for r in sums] == [pytest.approx(1.0)] * 3
    assert weighted.where("permno = 99").first()["weight_mktcap"] is None


def test_all_windows_share_one_shuffle(spark, months):
    n = 6
    df = months([0.1] * n, prc=[1.0] * n, vol=[1.0] * n, shrout=[1.0] * n, me=[1.0] * n, ex_ret=[0.1] * n, mkt_rf=[0.2] * n)
    df = signals.turnover(signals.dollar_volume(df))
    df = signals.momentum_count(signals.reversal(signals.momentum(df)))
    df = signals.size_factor(signals.beta(df))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 5, 15, 16, 17, 60, 240])
def test_moments_of_any_frame_equal_their_definition(months, rows):
    rng = random.Random(rows)
    stock = [None if rng.random() < 0.2 else rng.gauss(0, 0.1) for _ in range(70)]
    market = [None if rng.random() < 0.2 else rng.gauss(5, 0.1) for _ in range(70)]
    stock[10], market[11] = 1e9, -1e7  # leave no trace in later frames
    stock[30:50] = [0.1] * 20  # exactly constant
    df = months([0.0] * 70, ex_ret=stock, mkt_rf=market)
    ends = [slice(max(0, i - rows + 1), i + 1) for i in range(70)]
    found = signals.rolling_corr(signals.rolling_vol(df, rows), rows)
    known = [[x for x in stock[e] if x is not None] for e in ends]
    want = [statistics.stdev(xs) if len(xs) > 1 else None for xs in known]
    got = column(found, "stock_sd")
    assert all(g == w or g == pytest.approx(w, rel=1e-9) for g, w in zip(got, want, strict=True))
    assert all(g == 0 for g, xs in zip(got, known, strict=True) if len(xs) > 1 and len(set(xs)) == 1)
    pairs = [pearson(stock[e], market[e]) for e in ends]
    assert all(g == w or g == pytest.approx(w, abs=1e-8) for g, w in zip(column(found, "corr"), pairs, strict=True))


def test_frames_leave_other_columns_alone(months):
    df = months([0.1, 0.2, 0.4], ex_ret=[0.1, 0.2, 0.4], mkt_rf=[0.3, 0.1, 0.2], n=[1.0, 2.0, 3.0], x=[1.0, 2.0, 3.0])
    found = signals.rolling_vol(df, 3)
    assert found.columns == [*df.columns, "stock_sd", "mkt_sd"] and column(found, "n") == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError, match="row"):
        signals.rolling_corr(df, 0)
