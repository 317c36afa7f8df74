"""Portfolios sorted on a signal or on a prediction, from rows to wealth paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import portfolios
from panelforge.operators.quantiles import assign_quantile
from panelforge.operators.splits import label_samples
from panelforge.settings import Sample

# What makes a row distinct within a month after the fundamentals join.
ROW_KEY = ("permno", "gvkey", "lpermno", "datadate", "linkdt", "linktype", "linkprim")


def sample_starts(sample: Sample) -> dict[str, str | None]:
    """Reporting periods, each open at the front: whole, out of sample, recent."""
    return {"full": None, "out": sample.validation_end, "recent": sample.recent_after}


def sorted_portfolios(
    panel: DataFrame,
    signals: Sequence[str],
    n: int = 10,
    tie_break: Sequence[str] = ROW_KEY,
    ret_col: str = "ex_ret",
) -> DataFrame:
    """Monthly returns of the groups sorted on each signal: ``signal, grp, year, month, equal_ret, value_ret``.

    All signals are ranked in one distributed sort, each within its own cross-sections.
    """
    carried = dict.fromkeys(["date", "year", "month", "ret", ret_col, "size", "total_mktcap", "weight_mktcap", *tie_break])
    scores = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("score")) for s in signals])
    stacked = panel.select(*carried, F.inline(scores))
    grouped = assign_quantile(stacked, "score", n, ["signal", "date"], tie_break)
    return portfolios.portfolio_returns(grouped, ret_col, ["signal", "grp", "year", "month"])


def by_weighting(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both weightings below each other: ``weighting, ret`` next to group and month."""
    return returns.withColumnsRenamed({"equal_ret": "equal", "value_ret": "value"}).unpivot(
        [*by, "grp", "year", "month"], ["equal", "value"], "weighting", "ret"
    )


def sample_wealth(returns: DataFrame, starts: Mapping[str, str | None]) -> DataFrame:
    """Wealth per sub-sample, weighting and group, as one long table."""
    return portfolios.sample_paths(by_weighting(returns), starts, "ret", ["weighting", "grp"])


def back_test(
    predictions: DataFrame, n: int = 10, tie_break: Sequence[str] = ROW_KEY, by: Sequence[str] = (), sample: Sample | None = None
) -> dict[str, DataFrame]:
    """Portfolios sorted on the prediction, as lazy tables.

    ``prediction``: mean prediction per date and group; ``returns``: monthly returns per group;
    ``wealth``: their running products per weighting; ``equal`` and ``value``: month x group
    matrices. ``by`` keeps samples or models apart, so several are tested in one job. With ``sample`` given, each
    row is ranked once, and the groups' monthly tables are repeated for every test sample that holds the month.
    """
    by = list(by)
    grouped = assign_quantile(predictions, "prediction", n, [*by, "date"], tie_break)
    returns = portfolios.portfolio_returns(grouped, "ret", [*by, "grp", "year", "month"])
    means = portfolios.prediction_by_group(grouped, [*by, "date", "grp"])
    if sample:
        by = [*by, "sample"]
        returns = label_samples(returns.withColumn("date", portfolios.month_end()), sample).drop("date").where("sample <> 'train'")
        means = label_samples(means, sample).where("sample <> 'train'")
    months = [*by, "year", "month"]
    return {
        "prediction": means,
        "returns": returns,
        "wealth": portfolios.cumulative_return(by_weighting(returns, by), "ret", [*by, "weighting", "grp"]),
        "equal": portfolios.to_matrix(returns, "equal_ret", n, months),
        "value": portfolios.to_matrix(returns, "value_ret", n, months),
    }
