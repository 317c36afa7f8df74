"""Annualised statistics and side-by-side comparison of monthly return series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.numeric import ratio


def performance_stats(df: DataFrame, ret: str, by: Sequence[str] = ("grp",), periods: int = 12) -> DataFrame:
    """Annualised mean, sample volatility and their quotient per series."""
    stats = df.groupBy(*by).agg(
        (F.avg(ret) * periods).alias("annual_return"),
        (F.stddev_samp(ret) * F.sqrt(F.lit(float(periods)))).alias("annual_volatility"),
    )
    return stats.withColumn("sharpe", ratio("annual_return", "annual_volatility"))


def pick_legs(returns: DataFrame, legs: Mapping[str, tuple[str, int]], ret: str = "value_ret") -> DataFrame:
    """One group of one signal per strategy, as ``strategy, year, month, ret``.

    ``legs`` maps a strategy to its signal and group; all are picked in one pass over ``returns``.
    """
    names = [
        F.when((F.col("signal") == signal) & (F.col("grp") == grp), F.lit(strategy))
        for strategy, (signal, grp) in legs.items()
    ]
    return returns.select(
        F.explode(F.array_compact(F.array(*names))).alias("strategy"), "year", "month", F.col(ret).alias("ret")
    )


def compare_legs(picked: DataFrame, strategies: Sequence[str], value: str = "ret") -> DataFrame:
    """Months down, strategies across; a month missing from a strategy is NULL there."""
    return picked.groupBy("year", "month").pivot("strategy", list(strategies)).agg(F.first(value))
