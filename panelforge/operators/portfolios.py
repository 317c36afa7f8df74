"""Portfolio returns per group and month, wealth paths and sub-samples. All results are long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.numeric import ratio


def month_end(year: str = "year", month: str = "month") -> Column:
    return F.last_day(F.make_date(F.col(year), F.col(month), F.lit(1)))


def portfolio_returns(df: DataFrame, ret_col: str = "ret", by: Sequence[str] = ("grp", "year", "month")) -> DataFrame:
    """Equal-weighted mean of ``ret_col`` and value-weighted mean of ``ret`` per group and month.

    The value weights are shares of the whole market, so the sum is scaled by the group's share.
    """
    weighted = F.sum(F.col("ret") * F.col("weight_mktcap"))
    share = ratio(F.sum("size"), F.avg("total_mktcap"))
    return df.groupBy(*by).agg(
        F.avg(ret_col).alias("equal_ret"), ratio(weighted, share).alias("value_ret")
    )


def prediction_by_group(df: DataFrame, by: Sequence[str] = ("date", "grp")) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("prediction").alias("prediction"))


def to_matrix(
    df: DataFrame, value: str, n: int = 10, index: Sequence[str] = ("year", "month"), grp: str = "grp"
) -> DataFrame:
    """One row per period, columns ``g1..gn``; the group list is given, so no extra pass finds it."""
    cells = df.groupBy(*index).pivot(grp, list(range(1, n + 1))).agg(F.avg(value))
    return cells.select(*index, *[F.col(f"`{g}`").alias(f"g{g}") for g in range(1, n + 1)])


def market_equal(df: DataFrame) -> DataFrame:
    return df.groupBy("year", "month").agg(F.avg("ret").alias("ret"))


def market_value(df: DataFrame) -> DataFrame:
    """Sum of weighted returns; weights are not rescaled to the rows that are left."""
    return df.groupBy("year", "month").agg(F.sum(F.col("ret") * F.col("weight_mktcap")).alias("ret"))


def market_both(df: DataFrame) -> DataFrame:
    """Both market returns from one aggregate: ``year, month, weighting, ret``."""
    both = df.groupBy("year", "month").agg(
        F.avg("ret").alias("equal"), F.sum(F.col("ret") * F.col("weight_mktcap")).alias("value")
    )
    return both.unpivot(["year", "month"], ["equal", "value"], "weighting", "ret")


def subsamples(df: DataFrame, starts: Mapping[str, str | None], date: Column | None = None) -> DataFrame:
    """Each row once per sub-sample whose start lies before it; ``None`` starts at the beginning."""
    date = month_end() if date is None else date
    names = [
        F.lit(name) if start is None else F.when(date > F.lit(start).cast("date"), F.lit(name))
        for name, start in starts.items()
    ]
    return df.withColumn("sample", F.explode(F.array_compact(F.array(*names))))


def cumulative_return(
    df: DataFrame,
    ret: str,
    by: Sequence[str] = ("grp",),
    order: Sequence[str] = ("year", "month"),
    out: str = "wealth",
) -> DataFrame:
    """Running product of ``1 + ret`` in time order; a missing return stays missing and is skipped."""
    path = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.when(F.col(ret).isNotNull(), F.product(1 + F.col(ret)).over(path)))


def sample_paths(
    df: DataFrame, starts: Mapping[str, str | None], ret: str, by: Sequence[str] = (), date: Column | None = None
) -> DataFrame:
    """Wealth path of each sub-sample, started anew at its first month."""
    return cumulative_return(subsamples(df, starts, date), ret, ["sample", *by])


def terminal_wealth(
    df: DataFrame, periods: Mapping[str, tuple[str, str]], ret: str, by: Sequence[str] = ("grp",)
) -> DataFrame:
    """Wealth at the end of each period ``(after, until]``, started anew at its beginning."""
    date = month_end()
    names = [
        F.when((date > F.lit(after).cast("date")) & (date <= F.lit(until).cast("date")), F.lit(name))
        for name, (after, until) in periods.items()
    ]
    inside = df.withColumn("period", F.explode(F.array_compact(F.array(*names))))
    return inside.groupBy("period", *by).agg(F.product(1 + F.col(ret)).alias("wealth"))
