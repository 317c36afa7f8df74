"""From raw files to the panel that portfolios and models read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelforge.operators import cleaning, fundamentals, linking, signals
from panelforge.settings import Sample


def clean_months(raw: DataFrame, fmt: str | None = None) -> DataFrame:
    """Cleaned monthly file without the rows that have no id or date. The lagged price looks at every month that
    is left, before any is filtered out."""
    df = cleaning.with_calendar(cleaning.clean_price(cleaning.clean_returns(raw)), fmt=fmt)
    df = cleaning.identified(df)
    df = cleaning.with_lag(df, ["prc"])
    return cleaning.with_fiscal_year(cleaning.market_equity(df))


def universe_months(clean: DataFrame, sample: Sample) -> DataFrame:
    """Months and securities of the study, with their industry."""
    return cleaning.sic_division(cleaning.universe(cleaning.between_dates(clean, sample.start, sample.end)))


def signal_months(months: DataFrame, factors: DataFrame | None) -> DataFrame:
    """Every signal from a security's own history; without ``factors`` those that need none.

    Lags look at the filtered universe but at rows with and without a return. The factors are
    joined first, so that one sort by security serves all windows.
    """
    df = months if factors is None else signals.excess_return(signals.join_factors(months, factors))
    df = signals.turnover(signals.dollar_volume(df))
    df = signals.momentum_count(signals.reversal(signals.momentum(df)))
    return signals.size_factor(df if factors is None else signals.beta(df))


def security_panel(
    raw: DataFrame, factors: DataFrame | None, sample: Sample, fmt: str | None = None, weights: bool = True
) -> DataFrame:
    """Signals and market weights, one row per security and month with a return.

    Lazy but for the date totals, whose job reads only what the size needs. A consumer that selects
    few columns pays for few windows: store the selection, not the whole panel. One that sorts on a signal
    without benchmark or weights asks for neither: no ``factors`` joined, ``weights`` off, and nothing runs.
    """
    months = universe_months(clean_months(raw, fmt), sample)
    df = signal_months(months, factors)
    return cleaning.require(signals.value_weights(df) if weights else df, ["ret"])


def linked_accounts(accounts: DataFrame, links: DataFrame, sample: Sample) -> DataFrame:
    """Accounts with their securities, book equity, growth and ratios."""
    df = fundamentals.book_equity(linking.link_fundamentals(accounts, links, sample.as_of))
    return fundamentals.growth_lags(fundamentals.current_ratio(fundamentals.growth(df)))


# What portfolios, models and reports read from the accounts, next to the keys of the join.
ACCOUNT_ITEMS = (
    "gvkey", "lpermno", "lpermco", "linktype", "linkprim", "linkdt", "fyear", "datadate", "at", "lt", "she", "be", "revt", "ni", "at_growth",
    "revt_growth", "ni_growth", "xrd_growth", "xrd_growth_lag1", "xrd_growth_lag2", "current_ratio",
)


def research_panel(
    panel: DataFrame, accounts: DataFrame, dedupe: bool = False, items: Sequence[str] = ACCOUNT_ITEMS
) -> DataFrame:
    """Security panel with the accounts of the aligned fiscal year, value and price ratios."""
    joined = linking.join_fundamentals(panel, accounts.select(*items), dedupe)
    return fundamentals.price_ratios(fundamentals.value_factor(joined))
