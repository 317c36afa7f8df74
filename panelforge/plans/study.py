"""The whole study: raw files in, one table per result out."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import gram, linking, macro, models, performance, portfolios, profiling
from panelforge.plans import backtest, benchmarks, modelling
from panelforge.plans import panel as panels
from panelforge.settings import ALL_SIGNALS, CORE_SIGNALS, Sample
from panelforge.sources import panel_store, readers, schemas
from panelforge.storage import durable

DATE_FORMAT = "yyyy/MM/dd"
# Ridge penalty of the plain fit, the penalties compared, and the penalty of the other family fit.
RIDGE = 0.3
RIDGE_GRID = (1e-4, 1e-2, 1.0, 10.0)
FAMILY_RIDGE = 0.5
BENCHMARKS = ["momentum_12", "size", "value"]
BETA = "beta_lag"
# Signal and group that stand for each strategy.
LEGS = {
    "momentum": ("momentum_12", 10),
    "size": ("size", 1),
    "value": ("value", 1),
    "random_forest": ("rf", 10),
    "boosted_trees": ("gbt", 10),
}


def read_inputs(spark: SparkSession, paths: Mapping[str, str], sample: Sample, fmt: str = "csv") -> dict[str, DataFrame]:
    """The input files ``months``, ``factors``, ``accounts``, ``links`` and, where given, ``macro`` and ``extra``.

    Each file is read once: it is stored in its types, and the pass that stores it counts, per file and column, missing values
    and those that did not fit their type (``rejects``), and missing ids and dates, whose rows no result uses.
    """
    wanted = {
        "months": (schemas.SECURITY_MONTH, ["permno", "date"]),
        "accounts": (schemas.FUNDAMENTAL, ["gvkey", "datadate"]),
        "links": (schemas.LINK, ["gvkey", "lpermno"]),
        "macro": (schemas.MACRO, ["date"]),
        "extra": (schemas.FUNDAMENTAL_EXTRA, ["gvkey", "datadate"]),
    }
    raw = {name: readers.read_raw(spark, paths[name], fmt) for name in wanted if paths.get(name)}
    tables, counts = {}, []
    for name, df in raw.items():
        schema, keys = wanted[name]
        tables[name], measured = readers.ingest(df, schema, name, keys)
        counts.append(measured.select(F.lit(name).alias("file"), "*"))
    factors = readers.read_table(spark, paths["factors"], schemas.FACTOR_MONTH, fmt)
    for name in ("accounts", "extra"):
        if name in tables:
            tables[name] = readers.with_date(tables[name], "datadate", DATE_FORMAT)
    if "macro" in tables:
        tables["macro"] = macro.macro_long(readers.with_date(tables["macro"], "date", "yyyy-MM-dd"))
    return {
        **tables,
        "factors": readers.load_factors(factors, sample.start, sample.end),
        "rejects": reduce(DataFrame.unionByName, counts),
    }


def build_research(inputs: Mapping[str, DataFrame], sample: Sample, dedupe: bool = False) -> DataFrame:
    """The stored research panel all results are read from, with the industry's index and indicators.

    The macro series known in a month join it, and the extra item joins the accounts, where these are given.
    """
    panel = panels.security_panel(inputs["months"], durable(inputs["factors"], "factors"), sample, DATE_FORMAT)
    accounts, items = inputs["accounts"], panels.ACCOUNT_ITEMS
    if "extra" in inputs:
        accounts, items = linking.join_fundamental_extra(accounts, inputs["extra"]), (*items, "prba")
    accounts = panels.linked_accounts(accounts, inputs["links"], sample)
    research = panels.research_panel(panel, accounts, dedupe, items)
    if "macro" in inputs:
        research = macro.join_macro(research, inputs["macro"], sample.end)
    return models.encode_category(durable(research, "research", sort=["date"]), "industry", "industry_index", "industry_vector")


def store_panel(inputs: Mapping[str, DataFrame], sample: Sample, path: str, table: str = "security_panel", buckets: int = 64) -> DataFrame:
    """The security panel of the inputs, kept at ``path`` by year and security for later sessions.

    Years that the inputs hold are replaced, others stay, so a corrected year needs no other one; its first months' signals look back
    over the rows given, so hand in the years before it too.
    """
    panel = panels.security_panel(inputs["months"], durable(inputs["factors"], "factors"), sample, DATE_FORMAT)
    spark = panel.sparkSession
    panel_store.open_panel(spark, table, path, panel, buckets)
    panel_store.replace_years(spark, table, panel, buckets)
    return spark.table(table)


def sub_periods(sample: Sample) -> dict[str, tuple[str, str]]:
    """The samples in turn, each with the days before its first and of its last month."""
    return {
        "train": (sample.start, sample.train_end),
        "validation": (sample.train_end, sample.validation_end),
        "out": (sample.validation_end, sample.end),
    }


def benchmark_results(research: DataFrame, factors: DataFrame, sample: Sample) -> dict[str, DataFrame]:
    """Market and single-signal portfolios, among them those sorted on beta, and their wealth at the end of each sub-period."""
    starts = backtest.sample_starts(sample)
    whole_and_recent = {name: starts[name] for name in ("full", "recent")}
    sorted_on = durable(backtest.sorted_portfolios(research, [*BENCHMARKS, BETA]), "benchmark-returns")
    returns = sorted_on.where(F.col("signal") != BETA)
    beta = sorted_on.where(F.col("signal") == BETA).drop("signal")
    return {
        "beta_returns": beta,
        "beta_terminal": portfolios.terminal_wealth(beta, sub_periods(sample), "equal_ret"),
        "market": benchmarks.market_paths(research, whole_and_recent),
        "factor_market": benchmarks.factor_paths(factors, whole_and_recent),
        "benchmark_returns": returns,
        "benchmark_wealth": portfolios.sample_paths(
            backtest.by_weighting(returns, ["signal"]), starts, "ret", ["signal", "weighting", "grp"]
        ),
    }


def linear_results(rows: DataFrame, sample: Sample) -> dict[str, DataFrame]:
    """Least squares, ridge and gaussian fits on the small signal set, all from one pass over its rows.

    A gaussian model with identity link is the ridge fit of its penalty.
    """
    spark, months = rows.sparkSession, gram.monthly_statistics(rows, CORE_SIGNALS)
    parts = months.samples(sample)
    train = parts["train"]
    fits = {"ols": gram.fit(train), "ridge": gram.fit(train, RIDGE), "glm": gram.fit(train, RIDGE)}
    grid = {f"ridge {reg:g}": gram.fit(train, reg) for reg in RIDGE_GRID} | {"glm gaussian": gram.fit(train, FAMILY_RIDGE)}
    scored = gram.accuracy_table(spark, grid, {"validation": parts["validation"]})
    return {
        "coefficients": gram.coefficient_table(spark, CORE_SIGNALS, fits),
        "inference": gram.inference_table(spark, CORE_SIGNALS, train),
        "linear_accuracy": gram.accuracy_table(spark, fits, {n: parts[n] for n in ("train", "validation")}),
        "linear_by_month": gram.expanding_table(spark, months),
        "grid": scored.select(F.col("model").alias("setting"), "r2", "rmse"),
        "ols_predictions": modelling.predict_linear({"ols": fits["ols"]}, rows, CORE_SIGNALS, sample, modelling.DISJOINT),
    }


def tree_results(core: DataFrame, full: DataFrame, sample: Sample, partitions: int = 16) -> dict[str, DataFrame]:
    """Decision and boosted trees on both signal sets, forests on the full one, all on exact bins of the signals.

    Only a forest draws its bags by partition: ``partitions`` is part of it.
    """
    (core_bins, train_core), (bins, train) = (
        modelling.binned_train(rows, signals, sample) for rows, signals in ((core, CORE_SIGNALS), (full, ALL_SIGNALS))
    )
    bags = models.settled(train, ["permno", "date", "gvkey"], partitions)
    fits = {kind: models.tree(kind).fit(bags if kind == "rf" else train) for kind in ("dt", "rf", "gbt")}
    sparse = {f"{kind}_core": models.tree(kind).fit(train_core) for kind in ("dt", "gbt")}
    weights = [models.importances(fits[k], ALL_SIGNALS, train).withColumn("model", F.lit(k)) for k in ("rf", "gbt")]
    columns = ["model", "sample", "ret", "prediction"]
    predictions = modelling.predict_all(fits, full, bins, sample)
    scored = predictions.select(columns).unionByName(modelling.predict_all(sparse, core, core_bins, sample, ["validation"]).select(columns))
    return {
        "importances": reduce(DataFrame.unionByName, weights),
        "tree_accuracy": models.evaluate(scored, by=["model", "sample"]),
        "tree_predictions": predictions.where(F.col("model").isin("rf", "gbt")),
    }


def full_study(
    inputs: Mapping[str, DataFrame], sample: Sample = Sample(), dedupe: bool = False, tree_partitions: int = 16
) -> dict[str, DataFrame]:
    """Every result table by name. Shared inputs are stored on the way; the tables themselves are lazy."""
    research = build_research(inputs, sample, dedupe)
    results = {
        "rejects": inputs["rejects"],
        "profile": profiling.null_counts(research, research.columns),
        "summary": profiling.summary(research, ["date", "prc", "ret", "ex_ret"]),
        "industries": research.select("industry", "industry_index", vector_to_array("industry_vector").alias("onehot")).distinct(),
        **benchmark_results(research, inputs["factors"], sample),
    }
    core, full = (modelling.model_rows(research, signals) for signals in (CORE_SIGNALS, ALL_SIGNALS))
    results |= linear_results(core, sample) | tree_results(core, full, sample, tree_partitions)

    common = ["model", "sample", "prediction", "date", "year", "month", "ret", "size", "total_mktcap", "weight_mktcap"]
    columns = [*common, *backtest.ROW_KEY]
    predictions = results.pop("ols_predictions").select(columns).unionByName(results.pop("tree_predictions").select(columns))
    once = predictions.where(F.col("sample").isin(*modelling.DISJOINT)).drop("sample")
    tested = backtest.back_test(durable(once, "predictions"), by=["model"], sample=sample)
    returns = durable(tested["returns"], "model-returns")
    results["model_returns"] = returns
    results["model_predictions"] = tested["prediction"]
    results["model_wealth"] = portfolios.cumulative_return(
        backtest.by_weighting(returns, ["model", "sample"]), "ret", ["model", "sample", "weighting", "grp"]
    )

    out = returns.where(F.col("sample") == "out").drop("sample").withColumnRenamed("model", "signal")
    after = {"out": sample.validation_end}
    every = portfolios.subsamples(results["benchmark_returns"].unionByName(out), after).drop("sample")
    legs = performance.pick_legs(every, LEGS)
    results["performance"] = performance.performance_stats(every, "value_ret", ["signal", "grp"])
    results["strategy_performance"] = performance.performance_stats(legs, "ret", ["strategy"])
    results["strategy_returns"] = performance.compare_legs(legs, list(LEGS))
    results["strategy_wealth"] = performance.compare_legs(
        portfolios.cumulative_return(legs, "ret", ["strategy"]), list(LEGS), "wealth"
    )
    return results


def write_study(results: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "error") -> None:
    for name, table in results.items():
        readers.write_result(table, f"{folder}/{name}", fmt=fmt, mode=mode)
