"""Exact equal-count bins of signals, so that tree fits see few values and no sampled split points.

MLlib proposes split points from a sample of rows per partition where a signal has more values than bins. On binned
signals every boundary is a split point, none of which a sample of ten thousand rows can miss, so that a tree no
longer depends on how its rows are dealt.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.storage import durable

BINS = 32


def bin_counts(df: DataFrame, signals: Sequence[str], bins: int = BINS) -> DataFrame:
    """``signal, bin, low, rows``: per signal the bins that hold rows, with their least value.

    A value's bin follows from the share of rows below it, so equal values share one. Missing values do not count.
    Values are counted before they are sorted, all signals are sorted together by range over signal and value, and a value's rank is the
    rows of earlier tasks and those before it in its own: no signal is one task's.
    """
    pairs = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals))
    values = df.select(F.inline(pairs)).where("value IS NOT NULL AND NOT isnan(value)").groupBy("signal", "value").agg(F.count("*").alias("n"))
    ordered = values.repartitionByRange("signal", "value").sortWithinPartitions("signal", "value")
    ordered = durable(ordered.withColumn("task", F.spark_partition_id()), "values")
    whole = Window.partitionBy("signal")
    earlier = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = ordered.groupBy("signal", "task").agg(F.sum("n").alias("run")).select(
        "signal", "task", F.coalesce(F.sum("run").over(earlier), F.lit(0)).alias("before"), F.sum("run").over(whole).alias("total")
    )
    here = Window.partitionBy("signal", "task").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    below = F.col("before") + F.col("upto") - F.col("n")
    ranked = ordered.withColumn("upto", F.sum("n").over(here)).join(durable(runs, "value-runs"), ["signal", "task"])
    at = F.floor(below * bins / F.col("total")).cast("int")
    return ranked.groupBy("signal", at.alias("bin")).agg(F.min("value").alias("low"), F.sum("n").alias("rows"))


@dataclass(frozen=True)
class Binning:
    """Least values of each signal's bins but the first, ascending."""

    limits: Mapping[str, Sequence[float]]

    def features(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` with the vector of the signals' bin numbers; missing values have the bin after the last."""
        names = {s: f"{out}_{i}" for i, s in enumerate(self.limits)}
        splits = [[-math.inf, *(own or [sys.float_info.max]), math.inf] for own in self.limits.values()]  # three at least
        cut = Bucketizer(inputCols=list(names.values()), outputCols=[f"{n}_bin" for n in names.values()], splitsArray=splits, handleInvalid="keep")
        made = cut.transform(df.withColumns({n: F.coalesce(F.col(s).cast("double"), F.lit(math.nan)) for s, n in names.items()}))
        # A sum carries no column metadata: a tree would take a bucketed column for a category without order.
        made = made.withColumns({n: F.col(n) + F.lit(0.0) for n in cut.getOutputCols()})
        return VectorAssembler(inputCols=cut.getOutputCols(), outputCol=out).transform(made).drop(*names.values(), *cut.getOutputCols())


def fit_bins(df: DataFrame, signals: Sequence[str], bins: int = BINS) -> Binning:
    """Bins of the rows of ``df``. Runs jobs when called; one value per bin comes to the driver.

    A bin of fewer than half its fair share of rows, as between two frequent values, joins the one below it, the first one that above.
    """
    found: dict[str, list] = {s: [] for s in signals}
    for row in bin_counts(df, signals, bins).orderBy("signal", "bin").collect():
        found[row["signal"]].append([row["low"], row["rows"]])
    limits = {}
    for signal, own in found.items():
        least, kept = sum(n for _, n in own) / (2 * bins), []
        for low, n in own:
            if kept and (n < least or kept[-1][1] < least):
                kept[-1][1] += n
            else:
                kept.append([low, n])
        if len(kept) > 1 and kept[-1][1] < least:
            kept.pop()
        limits[signal] = tuple(low for low, _ in kept[1:])
    return Binning(limits)
