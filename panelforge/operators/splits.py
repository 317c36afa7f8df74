"""Time-ordered samples and model rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.cleaning import complete_cases
from panelforge.settings import MODEL_KEYS, Sample


def sample_filters(sample: Sample) -> dict[str, Column]:
    """Date predicate per sample; ``recent`` is the tail of ``out``."""
    date = F.col("date")

    def day(text: str) -> Column:
        return F.lit(text).cast("date")

    return {
        "train": date <= day(sample.train_end),
        "validation": (date > day(sample.train_end)) & (date <= day(sample.validation_end)),
        "out": date > day(sample.validation_end),
        "recent": date > day(sample.recent_after),
    }


def time_split(df: DataFrame, sample: Sample) -> dict[str, DataFrame]:
    return {name: df.where(inside) for name, inside in sample_filters(sample).items()}


def label_samples(df: DataFrame, sample: Sample) -> DataFrame:
    """Each row once per sample it belongs to, named in ``sample``."""
    names = [F.when(inside, F.lit(name)) for name, inside in sample_filters(sample).items()]
    return df.withColumn("sample", F.explode(F.array_compact(F.array(*names))))


def feature_set(
    df: DataFrame, signals: Sequence[str], keys: Sequence[str] = MODEL_KEYS, extra_keys: Sequence[str] = ()
) -> DataFrame:
    """Complete rows of signals and keys, each column once.

    ``extra_keys`` ride along without being required, such as the account that made a row distinct.
    """
    required = list(dict.fromkeys([*signals, *keys]))
    return complete_cases(df.select(*required, *[c for c in extra_keys if c not in required]), required)


def with_features(df: DataFrame, signals: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(signals), outputCol=out).transform(df)
