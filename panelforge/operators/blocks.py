"""Any sub-period of monthly returns from a few stored blocks: aggregates over power-of-two runs of months."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.numeric import ratio

#: Longest block: 2 ** 10 months are some 85 years.
LEVELS = 10


def month_number(day: str) -> int:
    """Months since year 0 of the last month that ends by ``day``."""
    at = date.fromisoformat(day)
    whole = (date.fromordinal(at.toordinal() + 1).month != at.month)
    return at.year * 12 + at.month - 1 - (not whole)


def month_blocks(returns: DataFrame, ret: str, by: Sequence[str] = ("grp",), levels: int = LEVELS) -> DataFrame:
    """``by, level, block, n, total, squares, wealth`` over the months of each block; months without a return do not count.

    One row of ``returns`` enters one block per level; they are added up before the shuffle.
    """
    month = F.col("year") * 12 + F.col("month") - 1
    each = returns.where(F.col(ret).isNotNull()).select(
        *by, F.col(ret).alias("ret"), month.cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    )
    return each.groupBy(*by, "level", F.expr("shiftright(m, level)").alias("block")).agg(
        F.count("*").alias("n"), F.sum("ret").alias("total"), F.sum(F.col("ret") * F.col("ret")).alias("squares"), F.product(1 + F.col("ret")).alias("wealth")
    )


def covering(first: int, stop: int, levels: int = LEVELS) -> list[tuple[int, int]]:
    """The fewest blocks ``(level, block)`` that make the months from ``first`` up to ``stop``, ``stop`` left out."""
    found = []
    while first < stop:
        level = 0
        while level < levels and first % (2 << level) == 0 and first + (2 << level) <= stop:
            level += 1
        found.append((level, first >> level))
        first += 1 << level
    return found


def period_stats(blocks: DataFrame, periods: Mapping[str, tuple[str, str]], by: Sequence[str] = ("grp",), per_year: int = 12) -> DataFrame:
    """``period, by, n, wealth, annual_return, annual_volatility, sharpe`` of the months after the first day of a period up to its last.

    Each period reads its few blocks; the returns are not read again. A period without a return has no row.
    """
    rows = [
        (name, level, block)
        for name, (after, until) in periods.items()
        for level, block in covering(month_number(after) + 1, month_number(until) + 1)
    ]
    wanted = blocks.sparkSession.createDataFrame(rows, "period string, level int, block int")
    sums = blocks.join(wanted, ["level", "block"]).groupBy("period", *by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.product("wealth").alias("wealth")
    )
    n = F.col("n")
    spread = F.greatest(F.col("squares") - F.col("total") * F.col("total") / n, F.lit(0.0))
    stats = sums.withColumn("annual_return", F.col("total") / n * per_year).withColumn(
        "annual_volatility", F.when(n > 1, F.sqrt(spread / (n - 1)) * F.sqrt(F.lit(float(per_year))))
    )
    return stats.select("period", *by, "n", "wealth", "annual_return", "annual_volatility", ratio("annual_return", "annual_volatility").alias("sharpe"))
