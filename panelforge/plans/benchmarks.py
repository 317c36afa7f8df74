"""Wealth paths of the market and of portfolios sorted on single signals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from panelforge.operators import portfolios


def market_paths(panel: DataFrame, starts: Mapping[str, str | None]) -> DataFrame:
    """Equal- and value-weighted market: ``sample, weighting, year, month, ret, wealth``."""
    return portfolios.sample_paths(portfolios.market_both(panel), starts, "ret", ["weighting"])


def factor_paths(factors: DataFrame, starts: Mapping[str, str | None]) -> DataFrame:
    """Wealth of the market factor: ``sample, date, ..., mkt, wealth``."""
    return portfolios.sample_paths(factors, starts, "mkt")
