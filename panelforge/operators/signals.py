"""Signals from a security's own history, and weights from the cross-section."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.numeric import log_positive, ratio
from panelforge.functions.rolling import (
    Moments,
    compound_return,
    correlation,
    history,
    rows_back,
    volatility,
    winning_months,
    with_moments,
)
from panelforge.storage import durable

# Rows back that open each momentum frame; all frames close two rows back.
MOMENTUM_FRAMES = {"momentum_12": 12, "momentum_6": 7, "momentum_36": 36}
SKIP = 2


def dollar_volume(df: DataFrame) -> DataFrame:
    """Previous row's log of traded value."""
    return df.withColumn("dvol", F.lag(log_positive(F.col("prc") * F.col("vol"))).over(history()))


def turnover(df: DataFrame) -> DataFrame:
    """Previous row's log of volume over shares outstanding."""
    return df.withColumn("turn", F.lag(log_positive(ratio("vol", "shrout"))).over(history()))


def momentum(
    df: DataFrame, frames: Mapping[str, int] = MOMENTUM_FRAMES, near: int = SKIP, min_obs: int = 0
) -> DataFrame:
    """Compound return over each frame of rows ``far`` to ``near`` back, all in one window."""
    window = history()
    return df.withColumns(
        {name: compound_return("ret", rows_back(window, far, near), min_obs) for name, far in frames.items()}
    )


def reversal(df: DataFrame) -> DataFrame:
    return df.withColumn("reversal", F.lag("ret").over(history()))


def momentum_count(df: DataFrame, far: int = 12, near: int = SKIP) -> DataFrame:
    return df.withColumn("momentum_count", winning_months("ret", rows_back(history(), far, near)))


def join_factors(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """Market and risk-free return of the month.

    No hint: the factor table should come from a file (or ``durable``), so Catalyst knows its size
    and broadcasts it while it is small. The panel then stays partitioned by security.
    """
    return panel.join(factors.select("year", "month", "mkt_rf", "rf"), ["year", "month"], "left")


def excess_return(df: DataFrame) -> DataFrame:
    return df.withColumn("ex_ret", F.col("ret") - F.col("rf"))


def _volatilities(n: int) -> dict[str, Moments]:
    return {"stock_sd": Moments(n, "ex_ret"), "mkt_sd": Moments(n, "mkt_rf")}


def rolling_vol(df: DataFrame, n: int = 12, min_obs: int = 0) -> DataFrame:
    frames = _volatilities(n)
    return with_moments(df, frames).withColumns({name: volatility(name, min_obs) for name in frames})


def rolling_corr(df: DataFrame, n: int = 60, min_obs: int = 0) -> DataFrame:
    return with_moments(df, {"corr": Moments(n, "ex_ret", "mkt_rf")}).withColumn("corr", correlation("corr", min_obs))


def shrink_beta(df: DataFrame, weight: float = 0.6) -> DataFrame:
    """Beta pulled towards one."""
    return df.withColumn("beta_shrink", weight * F.col("beta") + (1 - weight))


def beta(df: DataFrame, vol_n: int = 12, corr_n: int = 60, shrink: float = 0.6) -> DataFrame:
    """Beta from short-horizon volatilities and long-horizon correlation, with lags and squares."""
    frames = _volatilities(vol_n)
    df = with_moments(df, {**frames, "corr": Moments(corr_n, "ex_ret", "mkt_rf")})
    df = df.withColumns({**{name: volatility(name) for name in frames}, "corr": correlation("corr")})
    df = shrink_beta(df.withColumn("beta", ratio(F.col("corr") * F.col("stock_sd"), "mkt_sd")), shrink)
    window = history()
    df = df.withColumns(
        {"beta_lag": F.lag("beta").over(window), "beta_shrink_lag": F.lag("beta_shrink").over(window)}
    )
    return df.withColumns({f"{c}_square": F.pow(c, F.lit(2.0)) for c in ("beta_lag", "beta_shrink_lag")})


def size_factor(df: DataFrame) -> DataFrame:
    df = df.withColumn("size", F.lag("me").over(history()))
    return df.withColumn("log_size", log_positive("size"))


def total_mktcap(df: DataFrame) -> DataFrame:
    """Cross-section total of lagged market equity, one row per date."""
    return df.groupBy("date").agg(F.sum("size").alias("total_mktcap"))


def value_weights(df: DataFrame) -> DataFrame:
    """Share of each security in its date's total.

    A sum over a date window would bring a whole cross-section into one task; the total is
    aggregated map-side instead, stored, and joined back by its true size. ``df`` is read twice, the
    first time for date and size alone.
    """
    totals = durable(total_mktcap(df), "total-mktcap")
    return df.join(totals, "date", "left").withColumn("weight_mktcap", ratio("size", "total_mktcap"))
