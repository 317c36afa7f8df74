"""Macro series carried forward to every month of the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.rolling import history
from panelforge.settings import MACRO_SERIES
from panelforge.storage import durable


def macro_long(wide: DataFrame, series: Sequence[str] = MACRO_SERIES, date: str = "date") -> DataFrame:
    """``series, date, value`` from one column per series."""
    return wide.unpivot([date], list(series), "series", "value").select("series", F.col(date).alias("date"), "value")


def last_of_month(macro: DataFrame) -> DataFrame:
    """``series, seen, value``: the last known value of each series and month, under the month's first day.

    A series may be daily: of a month's observations the one of the latest date counts, of several on one date
    the greatest. Rows may carry ``date``, or ``year`` and ``month``.
    """
    date = F.col("date").cast("date") if "date" in macro.columns else F.make_date("year", "month", F.lit(1))
    known = macro.select("series", "value", date.alias("on")).where("value IS NOT NULL AND `on` IS NOT NULL")
    last = F.max_by("value", F.struct("on", "value"))
    return known.groupBy("series", F.trunc("on", "month").alias("seen")).agg(last.alias("value"))


def carried_forward(macro: DataFrame, series: Sequence[str], end: str) -> DataFrame:
    """One row per month up to ``end``, one column per series, each holding its last known value.

    Every observation is spread over the months until the next one of its series; no window spans
    more than one series.
    """
    known = last_of_month(macro.where(F.col("series").isin(list(series))))
    last = F.coalesce(
        F.add_months(F.lead("seen").over(history("series", "seen")), -1), F.trunc(F.lit(end).cast("date"), "month")
    )
    spread = (
        known.withColumn("last", last)
        .where(F.col("last") >= F.col("seen"))
        .select("series", "value", F.explode(F.expr("sequence(seen, last, interval 1 month)")).alias("at"))
    )
    return (
        spread.groupBy(F.year("at").alias("year"), F.month("at").alias("month"))
        .pivot("series", list(series))
        .agg(F.first("value"))
    )


def join_macro(
    panel: DataFrame, macro: DataFrame, end: str, series: Sequence[str] = MACRO_SERIES
) -> DataFrame:
    """Panel with the macro values known in its month. Stores the months' values when called."""
    monthly = durable(carried_forward(macro, series, end), "macro")
    return panel.join(monthly, ["year", "month"], "left")
