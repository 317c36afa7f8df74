"""From the research panel to fitted models and their predictions per sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.binning import Binning, fit_bins
from panelforge.operators.gram import Linear
from panelforge.operators.splits import feature_set, label_samples, sample_filters, time_split, with_features
from panelforge.plans.backtest import ROW_KEY
from panelforge.settings import Sample
from panelforge.storage import durable

TEST_SAMPLES = ("validation", "out", "recent")
#: Test samples that share no month; ``recent`` is the tail of ``out``.
DISJOINT = ("validation", "out")


def model_rows(panel: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Complete rows of signals and keys, stored in date order."""
    return durable(feature_set(panel, signals, extra_keys=ROW_KEY), "model-rows", sort=["date"])


def model_samples(rows: DataFrame, signals: Sequence[str], sample: Sample) -> dict[str, DataFrame]:
    """Assembled rows per sample, cut from one stored table."""
    return time_split(with_features(rows, signals), sample)


def binned_train(rows: DataFrame, signals: Sequence[str], sample: Sample) -> tuple[Binning, DataFrame]:
    """Exact bins of the training rows' signals, and those rows with binned features."""
    train = time_split(rows, sample)["train"]
    bins = fit_bins(train, signals)
    return bins, bins.features(train)


def stacked(scored: DataFrame, predictions: Mapping[str, str | Column], sample: Sample, names: Sequence[str]) -> DataFrame:
    """Rows with a column per model, as one row per ``model`` with its ``prediction``, once per ``sample`` they belong to.

    All samples come from one pass over the rows; the dates of the samples asked for reach the scan.
    """
    filters = sample_filters(sample)
    wanted = scored.where(reduce(Column.__or__, (filters[n] for n in names)))
    columns = [F.col(c) if isinstance(c, str) else c for c in predictions.values()]
    pairs = F.array(*(F.struct(F.lit(m).alias("model"), c.alias("prediction")) for m, c in zip(predictions, columns, strict=True)))
    kept = [c for c in wanted.columns if c not in ("features", *(c for c in predictions.values() if isinstance(c, str)))]
    long = wanted.select(*kept, F.explode(pairs).alias("scored")).select(*kept, "scored.*")
    labelled = label_samples(long, sample)
    return labelled if set(names) >= set(filters) else labelled.where(F.col("sample").isin(*names))


def predict_linear(
    models: Mapping[str, Linear], rows: DataFrame, signals: Sequence[str], sample: Sample, names: Sequence[str] = TEST_SAMPLES
) -> DataFrame:
    """Predictions of linear models per ``model`` and ``sample``, as plain column arithmetic over one scan."""
    return stacked(rows, {name: m.prediction(signals) for name, m in models.items()}, sample, names)


def predict_all(
    fits: Mapping[str, Model], rows: DataFrame, signals: Sequence[str] | Binning, sample: Sample, names: Sequence[str] = TEST_SAMPLES
) -> DataFrame:
    """Predictions of fitted models per ``model`` and ``sample``; every model scores a row in the same pass.

    ``signals`` are those the models were fitted on, or their bins.
    """
    scored, columns = signals.features(rows) if isinstance(signals, Binning) else with_features(rows, signals), {}
    for i, (name, model) in enumerate(fits.items()):
        columns[name] = f"prediction_{i}"
        scored = model.transform(scored, {model.predictionCol: columns[name]})
    return stacked(scored, columns, sample, names)
