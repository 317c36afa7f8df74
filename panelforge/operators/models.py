"""Regression models, their coefficients and their accuracy.

Fits are MLlib jobs: executors aggregate, the driver holds only the model. Hand in stored training
rows, since a fit passes over them more than once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.base import Estimator
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42


def index_category(df: DataFrame, column: str, out: str) -> DataFrame:
    """Frequency rank of the category from zero; ties go by name."""
    return StringIndexer(inputCol=column, outputCol=out).fit(df).transform(df)


def encode_category(df: DataFrame, column: str, index: str, onehot: str) -> DataFrame:
    """Frequency rank of the category and its indicator vector without the last category."""
    indexer = StringIndexer(inputCol=column, outputCol=index).fit(df)
    indexed = indexer.transform(df)
    if len(indexer.labels) < 2:  # nothing is left to indicate
        return indexed.withColumn(onehot, array_to_vector(F.array().cast("array<double>")))
    return OneHotEncoder(inputCols=[index], outputCols=[onehot], dropLast=True).fit(indexed).transform(indexed)


def linear(reg: float = 0.0, label: str = "ret", max_iter: int = 100) -> LinearRegression:
    """Least squares by the normal equations, with an optional ridge penalty."""
    return LinearRegression(
        labelCol=label, regParam=reg, elasticNetParam=0.0, maxIter=max_iter, solver="normal"
    )


def generalized_linear(
    reg: float = 0.3, family: str = "gaussian", link: str = "identity", label: str = "ret", max_iter: int = 10
) -> GeneralizedLinearRegression:
    return GeneralizedLinearRegression(labelCol=label, family=family, link=link, regParam=reg, maxIter=max_iter)


def tree(kind: str, label: str = "ret", **params) -> Estimator:
    """``dt``, ``rf`` or ``gbt``, always seeded."""
    if kind == "dt":
        return DecisionTreeRegressor(labelCol=label, seed=SEED, **params)
    if kind == "rf":
        return RandomForestRegressor(labelCol=label, seed=SEED, **params)
    if kind == "gbt":
        return GBTRegressor(labelCol=label, seed=SEED, **{"maxIter": 15, **params})
    raise ValueError(f"unknown tree kind: {kind}")


def settled(train: DataFrame, order: Sequence[str] = ("permno", "date"), partitions: int = 16) -> DataFrame:
    """Rows in a fixed partition and order, so that a seeded tree draws the same samples again.

    Forests draw their bags by partition, and above some ten thousand rows MLlib proposes the split points of signals that
    are not binned (``binning``) from a sample of rows per partition. So the number of partitions is part of
    such a model; it is set here and not taken from the cluster's settings. Raise it with the training rows. Rows are
    dealt by all columns of ``order``, so that a security with many rows is not one task.
    """
    return train.repartition(partitions, *order).sortWithinPartitions(*order)


def coefficients(model: Model, signals: Sequence[str], df: DataFrame) -> DataFrame:
    """``term, estimate`` of a linear model; ``df`` lends its session."""
    rows = [("intercept", float(model.intercept)), *zip(signals, (float(c) for c in model.coefficients))]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double")


def inference(model: Model, signals: Sequence[str], df: DataFrame) -> DataFrame:
    """``term, estimate, std_error, t_value, p_value`` of an unpenalised linear model."""
    s = model.summary
    rows = zip(
        [*signals, "intercept"],
        [*(float(c) for c in model.coefficients), float(model.intercept)],
        s.coefficientStandardErrors,
        s.tValues,
        s.pValues,
    )
    return df.sparkSession.createDataFrame(
        list(rows), "term string, estimate double, std_error double, t_value double, p_value double"
    )


def importances(model: Model, signals: Sequence[str], df: DataFrame) -> DataFrame:
    """``signal, importance`` of a tree model."""
    values = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame(
        [(name, float(v)) for name, v in zip(signals, values)], "signal string, importance double"
    )


def r2(label: str, prediction: str):
    miss = F.col(label) - F.col(prediction)
    return 1 - F.try_divide(F.sum(miss * miss), F.var_pop(label) * F.count(label))


def rmse(label: str, prediction: str):
    miss = F.col(label) - F.col(prediction)
    return F.sqrt(F.avg(miss * miss))


def evaluate(df: DataFrame, label: str = "ret", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """``n, r2, rmse`` per group in one aggregate."""
    return df.groupBy(*by).agg(
        F.count(label).alias("n"), r2(label, prediction).alias("r2"), rmse(label, prediction).alias("rmse")
    )


def grid_evaluate(
    estimators: Mapping[str, Estimator], train: DataFrame, validation: DataFrame, label: str = "ret"
) -> DataFrame:
    """``setting, r2, rmse`` on a later sample, one row per estimator.

    The samples are ordered in time, so there are no random folds. Every model scores the
    validation rows in the same pass.
    """
    scored, measures, rows = validation, [], []
    for i, (setting, estimator) in enumerate(estimators.items()):
        out = f"prediction_{i}"
        scored = estimator.fit(train).setPredictionCol(out).transform(scored)
        measures += [r2(label, out).alias(f"r2_{i}"), rmse(label, out).alias(f"rmse_{i}")]
        rows.append(
            F.struct(F.lit(setting).alias("setting"), F.col(f"r2_{i}").alias("r2"), F.col(f"rmse_{i}").alias("rmse"))
        )
    return scored.agg(*measures).select(F.explode(F.array(*rows)).alias("row")).select("row.*")
