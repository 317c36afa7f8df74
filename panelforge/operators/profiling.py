"""Looking at a table: counts, missing values, summaries, look-ups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """One row per column from a single aggregate over the table."""
    wide = df.agg(*[measure(c).alias(f"{c}|{name}") for c in columns for name, measure in measures.items()])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{name}`").alias(name) for name in measures]) for c in columns
    ]
    return wide.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and missing values per column."""
    return _per_column(
        df, columns, {"rows": lambda c: F.count(F.lit(1)), "nulls": lambda c: F.count_if(F.col(c).isNull())}
    )


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample standard deviation, least and greatest value per column.

    Columns that are no numbers (dates, text) have a count, but no moments and no numeric extremes.
    """
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}

    def numbers(measure: Callable[[str], Column]) -> Callable[[str], Column]:
        return lambda c: measure(F.col(c).cast("double")) if c in numeric else F.lit(None).cast("double")

    return _per_column(
        df.select(*columns),
        columns,
        {"count": F.count, "mean": numbers(F.avg), "stddev": numbers(F.stddev_samp), "min": numbers(F.min), "max": numbers(F.max)},
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def securities(df: DataFrame, ids: DataFrame | Sequence[int], columns: Sequence[str], key: str = "permno") -> DataFrame:
    """Rows of the given securities: a short list is pushed to the scan, a table is semi-joined."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi").select(*columns)
    return df.where(F.col(key).isin(list(ids))).select(*columns)


def top_returns(df: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` highest returns; ties go to the lower security, then the earlier date."""
    return df.orderBy(F.col("ret").desc_nulls_last(), "permno", "date").limit(n)
