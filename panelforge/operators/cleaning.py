"""Cleaning and universe selection for the monthly security file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from panelforge.functions.equity import RETURN_SENTINELS, division, parsed_return
from panelforge.functions.rolling import history
from panelforge.sources.readers import whole_number


def clean_returns(
    df: DataFrame, ret: str = "ret", code: str = "siccd", sentinels: Sequence[str] = RETURN_SENTINELS
) -> DataFrame:
    """Numeric return and integer industry code (``3714.0`` is 3714); sentinels and bad text become NULL."""
    return df.withColumns(
        {ret: parsed_return(F.col(ret).cast("string"), sentinels), code: whole_number(F.col(code), IntegerType())}
    )


def identified(df: DataFrame, keys: Sequence[str] = ("permno", "date")) -> DataFrame:
    """Rows with every key. Others belong to no security or month: they must not share a window."""
    return require(df, keys)


def clean_price(df: DataFrame) -> DataFrame:
    """A negative price marks a bid/ask midpoint; keep its size."""
    return df.withColumn("prc", F.abs("prc"))


def market_equity(df: DataFrame) -> DataFrame:
    return df.withColumn("me", F.col("prc") * F.col("shrout"))


def with_calendar(df: DataFrame, column: str = "date", fmt: str | None = None) -> DataFrame:
    """Real date plus ``year`` and ``month``; ``fmt`` parses a text date, bad text becomes NULL."""
    date = F.col(column) if fmt is None else F.try_to_date(F.col(column).cast("string"), fmt)
    return df.withColumn(column, date).withColumns({"year": F.year(column), "month": F.month(column)})


def with_fiscal_year(df: DataFrame, lag_months: int = 18) -> DataFrame:
    """Fiscal year whose accounts are public: July to next June use the accounts of the year before."""
    return df.withColumn("fdate", F.add_months("date", -lag_months)).withColumn("fyear", F.year("fdate"))


def with_lag(df: DataFrame, columns: Sequence[str], n: int = 1, by: str = "permno", order: str = "date") -> DataFrame:
    """``<column>_lag`` from ``n`` rows earlier, all in one window."""
    window = history(by, order)
    return df.withColumns({f"{c}_lag": F.lag(c, n).over(window) for c in columns})


def between_dates(df: DataFrame, start: str, end: str, column: str = "date") -> DataFrame:
    return df.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def universe(df: DataFrame, shrcd: Sequence[int] = (10, 11), exchcd: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Common shares on the main exchanges."""
    return df.where(F.col("shrcd").isin(list(shrcd)) & F.col("exchcd").isin(list(exchcd)))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with every one of ``columns`` present."""
    for column in columns:
        df = df.where(F.col(column).isNotNull())
    return df


def min_price(df: DataFrame, floor: float = 5) -> DataFrame:
    return df.where(F.col("prc") >= floor)


def sic_division(df: DataFrame, code: str = "siccd", out: str = "industry") -> DataFrame:
    return df.withColumn(out, division(code))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with neither NULL nor NaN in ``columns``; repeated names count once."""
    return df.na.drop(subset=list(dict.fromkeys(columns)))
