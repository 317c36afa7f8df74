"""Book equity, growth and ratios from annual accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.equity import deferred_tax, preferred_stock, shareholder_equity
from panelforge.functions.numeric import growth_rate, ratio
from panelforge.functions.rolling import history

GROWTH_ITEMS = ("at", "revt", "ni", "xrd")


#: What tells accounts of one company and date apart: a date under two links appears twice.
ACCOUNT_ORDER = ("datadate", "lpermno", "linkdt", "linktype", "linkprim")


def account_history(df: DataFrame):
    """One company's accounts in date order; repeated dates are ordered by the link, as far as ``df`` has it."""
    return history("gvkey", [c for c in ACCOUNT_ORDER if c in df.columns])


def book_equity(df: DataFrame) -> DataFrame:
    """Equity plus deferred tax less preferred stock; NULL when any of the three is unknown."""
    df = df.withColumns({"she": shareholder_equity(), "dt": deferred_tax(), "ps": preferred_stock()})
    return df.withColumn("be", F.col("she") - F.col("ps") + F.col("dt"))


def growth(df: DataFrame, items: Sequence[str] = GROWTH_ITEMS) -> DataFrame:
    """``<item>_lag`` and ``<item>_growth`` against the company's previous account."""
    window = account_history(df)
    df = df.withColumns({f"{c}_lag": F.lag(c).over(window) for c in items})
    return df.withColumns({f"{c}_growth": growth_rate(c, f"{c}_lag") for c in items})


def growth_lags(df: DataFrame, column: str = "xrd_growth", lags: Sequence[int] = (1, 2)) -> DataFrame:
    """``<column>_lag<k>`` from ``k`` accounts earlier."""
    window = account_history(df)
    return df.withColumns({f"{column}_lag{k}": F.lag(column, k).over(window) for k in lags})


def current_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("current_ratio", ratio("act", "lct"))


def value_factor(df: DataFrame) -> DataFrame:
    return df.withColumn("value", ratio("be", "size"))


def price_ratios(df: DataFrame) -> DataFrame:
    """Firm totals over the per-share price of the previous row."""
    return df.withColumns({"ep": ratio("ni", "prc_lag"), "sp": ratio("revt", "prc_lag")})
