"""Linear models from statistics that add up: one pass over the rows makes one small row per month.

Any sample is a sum of months, so every split, penalty and accuracy follows without reading rows again. A month's row holds
the count, the means and the sums of products of deviations of all signals and the label; two of them are merged about
their common mean, which loses no digits where means are large. The months' rows come to the driver: as many as the calendar has.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.settings import Sample


@dataclass(frozen=True)
class Statistics:
    """Count, means, and sums of products of deviations; the label is the last variable."""

    n: int
    mean: np.ndarray
    spread: np.ndarray

    def __add__(self, other: Statistics) -> Statistics:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        mean = self.mean + gap * (other.n / n)
        return Statistics(n, mean, self.spread + other.spread + np.outer(gap, gap) * (self.n * other.n / n))


@dataclass(frozen=True)
class Linear:
    intercept: float
    slopes: tuple[float, ...]

    def prediction(self, signals: Sequence[str]) -> Column:
        """The model as a column of the signals' columns."""
        parts = [F.lit(b) * F.col(s) for b, s in zip(self.slopes, signals, strict=True)]
        return reduce(Column.__add__, parts, F.lit(self.intercept))


def month_statistics(df: DataFrame, signals: Sequence[str], label: str = "ret", by: str = "date") -> DataFrame:
    """``by, n, mean, spread`` per month of the complete rows, in one aggregate; ``spread`` is the upper triangle by rows."""
    names = [*signals, label]
    whole = df.select(by, *(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in names)).na.drop()
    n = F.count("*")
    spread = [F.covar_pop(a, b) * n for i, a in enumerate(names) for b in names[i:]]
    return whole.groupBy(by).agg(n.alias("n"), F.array(*map(F.avg, names)).alias("mean"), F.array(*spread).alias("spread"))


class MonthlyStatistics:
    """The statistics of each month on the driver, and of any span of months."""

    def __init__(self, months: DataFrame, signals: Sequence[str]):
        self.signals, size = list(signals), len(signals) + 1
        upper = np.triu_indices(size)
        self.months: list[tuple[date, Statistics]] = []
        for row in sorted(months.collect(), key=lambda r: r[0]):
            spread = np.zeros((size, size))
            spread[upper] = row["spread"]
            self.months.append((row[0], Statistics(row["n"], np.array(row["mean"]), spread + np.triu(spread, 1).T)))
        self.none = Statistics(0, np.zeros(size), np.zeros((size, size)))

    def span(self, after: str | None = None, until: str | None = None) -> Statistics:
        """All months later than ``after`` and up to ``until``."""
        own = [s for d, s in self.months if (not after or d > date.fromisoformat(after)) and (not until or d <= date.fromisoformat(until))]
        return reduce(Statistics.__add__, own, self.none)

    def samples(self, sample: Sample) -> dict[str, Statistics]:
        return {
            "train": self.span(None, sample.train_end),
            "validation": self.span(sample.train_end, sample.validation_end),
            "out": self.span(sample.validation_end),
            "recent": self.span(sample.recent_after),
        }

    def expanding(self, least_rows: int = 3) -> list[tuple[date, Statistics]]:
        """For each month all rows up to it, from ``least_rows`` rows on."""
        found, so_far = [], self.none
        for day, own in self.months:
            so_far = so_far + own
            if so_far.n >= least_rows:
                found.append((day, so_far))
        return found


def monthly_statistics(df: DataFrame, signals: Sequence[str], label: str = "ret") -> MonthlyStatistics:
    """Runs the one job that all linear fits need."""
    return MonthlyStatistics(month_statistics(df, signals, label), signals)


def deviations(stats: Statistics) -> np.ndarray:
    """Population deviations; zero where nothing but rounding of the mean is left."""
    sd = np.sqrt(np.maximum(np.diag(stats.spread), 0) / max(stats.n, 1))
    return np.where(sd > 1e-14 * np.abs(stats.mean), sd, 0.0)


def fit(stats: Statistics, reg: float = 0.0) -> Linear:
    """Least squares, with an optional ridge penalty on standardised signals over the label's deviation.

    A constant signal has slope zero; among signals that determine each other the shortest standardised solution is taken. Without
    rows everything is zero.
    """
    p = len(stats.mean) - 1
    cov = stats.spread / max(stats.n, 1)
    sd = deviations(stats)
    varies = sd[:p] > 0
    slopes = np.zeros(p)
    if sd[p] > 0 and varies.any():
        scale = sd[:p][varies]
        matrix = cov[:p, :p][np.ix_(varies, varies)] / np.outer(scale, scale) + reg / sd[p] * np.eye(len(scale))
        slopes[varies] = np.linalg.lstsq(matrix, cov[:p, p][varies] / scale, rcond=1e-13)[0] / scale
    return Linear(float(stats.mean[p] - slopes @ stats.mean[:p]), tuple(map(float, slopes)))


def squared_error(stats: Statistics, model: Linear) -> float:
    """Sum of squared errors of any linear model on the rows of ``stats``."""
    p, b = len(model.slopes), np.array(model.slopes)
    around = stats.spread[p, p] - 2 * b @ stats.spread[:p, p] + b @ stats.spread[:p, :p] @ b
    return float(max(around, 0.0) + stats.n * (stats.mean[p] - model.intercept - b @ stats.mean[:p]) ** 2)


def accuracy(stats: Statistics, model: Linear) -> tuple[int, float | None, float | None]:
    """``n, r2, rmse``; r2 is null where the label does not vary, both without rows."""
    error, total = squared_error(stats, model), float(stats.spread[-1, -1])
    return stats.n, 1 - error / total if total else None, math.sqrt(error / stats.n) if stats.n else None


def student_tail(t: float, freedom: int) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    if x == 0:
        return 1.0 if flip else 0.0
    value, numerator, denominator = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        term = 1.0 if not k else m * (b - m) * x / ((a + k - 1) * (a + k)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + k - 1) * (a + k))
        denominator = 1 / (1 + term * denominator or 1e-300)
        numerator = 1 + term / numerator or 1e-300
        value *= numerator * denominator
        if abs(numerator * denominator - 1) < 1e-15:
            break
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    part = front * (value - 1)
    return min(1.0, max(0.0, 1 - part if flip else part))


def coefficient_table(spark: SparkSession, signals: Sequence[str], models: Mapping[str, Linear]) -> DataFrame:
    """``model, term, estimate``."""
    rows = [(name, t, v) for name, m in models.items() for t, v in zip(["intercept", *signals], [m.intercept, *m.slopes], strict=True)]
    return spark.createDataFrame(rows, "model string, term string, estimate double")


def accuracy_table(spark: SparkSession, models: Mapping[str, Linear], samples: Mapping[str, Statistics]) -> DataFrame:
    """``model, sample, n, r2, rmse`` of every model on every sample."""
    rows = [(name, part, *accuracy(stats, m)) for name, m in models.items() for part, stats in samples.items()]
    return spark.createDataFrame(rows, "model string, sample string, n long, r2 double, rmse double")


def inference_table(spark: SparkSession, signals: Sequence[str], stats: Statistics) -> DataFrame:
    """``term, estimate, std_error, t_value, p_value`` of the unpenalised model.

    Only where every signal varies, none is determined by the others and rows are left over; errors are null otherwise.
    """
    model, p, freedom = fit(stats), len(signals), stats.n - len(signals) - 1
    errors: list[float | None] = [None] * (p + 1)
    scale = deviations(stats)[:p]
    alike = stats.spread[:p, :p] / np.outer(scale, scale) if scale.all() else np.zeros((p, p))
    if freedom > 0 and np.linalg.matrix_rank(alike, hermitian=True) == p:
        inverse = np.linalg.inv(alike) / np.outer(scale, scale)
        mean = stats.mean[:p]
        s2 = squared_error(stats, model) / freedom
        errors = [math.sqrt(s2 * v) for v in (1 / stats.n + mean @ inverse @ mean, *np.diag(inverse))]
    rows = []
    for term, value, error in zip(["intercept", *signals], [model.intercept, *model.slopes], errors, strict=True):
        t = value / error if error else None
        rows.append((term, value, error, t, None if t is None else student_tail(t, freedom)))
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, t_value double, p_value double")


def expanding_table(spark: SparkSession, months: MonthlyStatistics, reg: float = 0.0) -> DataFrame:
    """``date, n, term, estimate, r2`` of the model fitted on all rows up to each month."""
    rows = []
    for day, stats in months.expanding():
        model = fit(stats, reg)
        r2 = accuracy(stats, model)[1]
        rows += [(day, stats.n, t, v, r2) for t, v in zip(["intercept", *months.signals], [model.intercept, *model.slopes], strict=True)]
    return spark.createDataFrame(rows, "date date, n long, term string, estimate double, r2 double")
