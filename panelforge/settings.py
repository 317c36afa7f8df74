"""Sample boundaries and the fixed signal lists."""

from __future__ import annotations

from dataclasses import dataclass

# Signals of the small and of the full model, in model order.
CORE_SIGNALS = ["momentum_12", "log_size", "value"]
ALL_SIGNALS = [
    "momentum_12", "momentum_count", "momentum_6", "momentum_36", "reversal",
    "beta_lag", "beta_shrink_lag", "beta_lag_square", "beta_shrink_lag_square",
    "size", "log_size", "revt", "be", "value", "dvol", "turn", "ep", "sp",
    "at_growth", "ni_growth", "revt_growth", "current_ratio",
]
# What a model row carries next to its signals.
MODEL_KEYS = ["ret", "permno", "date", "year", "month", "size", "total_mktcap", "weight_mktcap"]
# Macro series ids.
MACRO_SERIES = ["CPIAUCSL", "CPILFESL", "GDP", "GS1", "GS10", "T10Y2Y", "T10Y3M", "TEDRATE"]


@dataclass(frozen=True)
class Sample:
    """Dates that bound the study; all ISO strings, all inclusive ends."""

    start: str = "1957-03-01"
    train_end: str = "1974-12-31"
    validation_end: str = "1986-12-31"
    recent_after: str = "2010-01-01"
    end: str = "2016-12-31"
    as_of: str = "2016-12-31"
