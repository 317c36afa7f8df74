"""Arithmetic that yields NULL where ANSI mode would raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient; NULL on a zero denominator."""
    return F.try_divide(as_column(numerator), as_column(denominator))


def log_positive(x: Column | str) -> Column:
    """Natural logarithm; NULL for zero and negative input."""
    x = as_column(x)
    return F.when(x > 0, F.ln(x))


def growth_rate(now: Column | str, before: Column | str) -> Column:
    """Relative change against the earlier value."""
    return ratio(as_column(now) - as_column(before), before)
