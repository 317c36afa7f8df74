"""The registered queries: the library run over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy
from functools import cache, cached_property, partial, reduce

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from checks.outputs import spark_output
from panelforge.operators import blocks, cleaning, fundamentals, gram, linking, macro, models, performance, portfolios, profiling
from panelforge.operators import signals, splits
from panelforge.operators.asof import asof_join
from panelforge.operators.binning import Binning
from panelforge.operators.quantiles import assign_quantile
from panelforge.plans import append, backtest, benchmarks, modelling
from panelforge.plans import panel as panels
from panelforge.settings import ALL_SIGNALS, CORE_SIGNALS, MODEL_KEYS, Sample
from panelforge.sources import star_schema
from panelforge.sources.panel_store import open_panel, replace_years
from panelforge.sources.readers import ingest, load_factors, typed
from panelforge.storage import durable, new_path

SAMPLE = Sample("1995-01-01", "1998-12-31", "2000-06-30", "2001-01-01", "2001-12-31", "2002-01-01")
STARTS = backtest.sample_starts(SAMPLE)
WHOLE_AND_RECENT = {name: STARTS[name] for name in ("full", "recent")}
PERIODS = {
    "1995-1996": ("1994-12-31", "1996-12-31"),
    "1997-1998": ("1996-12-31", "1998-12-31"),
    "1999-2000": ("1998-12-31", "2000-12-31"),
    "2001": ("2000-12-31", "2001-12-31"),
}
# Macro series of the test tables and the column each becomes.
SERIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
RIDGE_GRID = [1e-4, 1e-2, 1.0, 10.0]
PROFILED = ["be", "me", "value", "permno", "she"]
RANK_DIGITS = 9
# Signals of the sorts that strategies are compared with.
SORTED = ["momentum_12", "size", "value"]
STORE_BUCKETS = 8
APPEND_AFTER = ("1998-12-31", "2001-10-31")
YEAR_ENDS = [f"{y}-12-31" for y in range(1994, 2002)]
ANY_PERIOD = {f"{a[:4]}-{b[:4]}": (a, b) for i, a in enumerate(YEAR_ENDS) for b in YEAR_ENDS[i + 1 :]}


class Study:
    """Inputs and intermediate tables of one run, each built at most once and only when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.table = cache(partial(star_schema.table, spark, folder))

    @cached_property
    def raw(self) -> DataFrame:
        return star_schema.security_months(self.table("lineitem"), self.table("supplier"))

    @cached_property
    def factors(self) -> DataFrame:
        return durable(load_factors(star_schema.factor_file(self.table("orders")), SAMPLE.start, SAMPLE.end), "factors")

    @cached_property
    def accounts(self) -> DataFrame:
        return star_schema.fundamentals(self.table("lineitem"))

    @cached_property
    def links(self) -> DataFrame:
        return star_schema.links(self.table("supplier"))

    @cached_property
    def clean(self) -> DataFrame:
        return panels.clean_months(self.raw)

    @cached_property
    def months(self) -> DataFrame:
        return panels.universe_months(self.clean, SAMPLE)

    @cached_property
    def with_factors(self) -> DataFrame:
        return signals.excess_return(signals.join_factors(self.months, self.factors))

    @cached_property
    def sized(self) -> DataFrame:
        return signals.size_factor(self.months)

    @cached_property
    def panel(self) -> DataFrame:
        return panels.security_panel(self.raw, self.factors, SAMPLE)

    @cached_property
    def linked(self) -> DataFrame:
        return panels.linked_accounts(self.accounts, self.links, SAMPLE)

    @cached_property
    def research(self) -> DataFrame:
        return panels.research_panel(self.panel, self.linked)

    def sharing(self, signals: Sequence[str]) -> Study:
        """This study over a stored research panel of the columns that models of ``signals`` and sorts on the core signals
        read, so that its windows and joins run once where a query builds several tables from it."""
        columns = dict.fromkeys([*signals, *MODEL_KEYS, "ex_ret", *SORTED, *backtest.ROW_KEY])
        other = copy(self)
        other.research = durable(self.research.select(*columns), "research")
        return other

    @cached_property
    def unweighted(self) -> DataFrame:
        """The research panel without market weights."""
        return panels.research_panel(panels.security_panel(self.raw, self.factors, SAMPLE, weights=False), self.linked)

    @cached_property
    def plain(self) -> DataFrame:
        """The research panel without market weights and without what needs the factors."""
        return panels.research_panel(panels.security_panel(self.raw, None, SAMPLE, weights=False), self.linked)

    @cached_property
    def industries(self) -> DataFrame:
        return durable(self.months.select("permno", "date", "industry"), "industry")

    @cached_property
    def indexed(self) -> DataFrame:
        return models.index_category(self.industries, "industry", "industry_index")

    def deciles(self, signal: str, **options) -> DataFrame:
        narrow = rankable(self.plain, signal).select(signal, *dict.fromkeys(["date", *backtest.ROW_KEY]))
        return assign_quantile(durable(narrow, "scores"), signal, tie_break=backtest.ROW_KEY, **options)

    def portfolios(self, *ranked: str) -> DataFrame:
        """Sorts keep the sizes that weigh them, so a signal is rounded under its own name."""
        rounded = {f"by_{s}": F.round(s, RANK_DIGITS) for s in ranked}
        weighed = ["date", "year", "month", "ret", "ex_ret", "size", "total_mktcap", "weight_mktcap", *backtest.ROW_KEY]
        narrow = self.research.withColumns(rounded).select(*weighed, *rounded)
        return backtest.sorted_portfolios(durable(narrow, "scores"), list(rounded))

    @cached_property
    def core(self) -> DataFrame:
        return modelling.model_rows(self.research, CORE_SIGNALS)

    @cached_property
    def full(self) -> DataFrame:
        return modelling.model_rows(self.research, ALL_SIGNALS)

    @cached_property
    def binned(self) -> tuple[Binning, DataFrame]:
        return modelling.binned_train(self.full, ALL_SIGNALS, SAMPLE)

    def train(self, rows: DataFrame, signals: list[str]) -> DataFrame:
        return models.settled(modelling.model_samples(rows, signals, SAMPLE)["train"], ["permno", "date", "gvkey"])

    @cached_property
    def months_statistics(self) -> gram.MonthlyStatistics:
        return gram.monthly_statistics(self.core, CORE_SIGNALS)

    @cached_property
    def core_statistics(self) -> dict[str, gram.Statistics]:
        return self.months_statistics.samples(SAMPLE)

    def linear(self, reg: float = 0.0) -> gram.Linear:
        return gram.fit(self.core_statistics["train"], reg)

    def linear_terms(self, reg: float = 0.0) -> DataFrame:
        return gram.coefficient_table(self.spark, CORE_SIGNALS, {"linear": self.linear(reg)})

    def linear_predictions(self, reg: float = 0.0, names: tuple[str, ...] = modelling.TEST_SAMPLES) -> DataFrame:
        return modelling.predict_linear({"linear": self.linear(reg)}, self.core, CORE_SIGNALS, SAMPLE, names)

    @cached_property
    def ols_predictions(self) -> DataFrame:
        return self.linear_predictions()

    def ols_back_test(self) -> dict[str, DataFrame]:
        predictions = durable(self.linear_predictions(names=modelling.DISJOINT), "ols").drop("sample")
        return backtest.back_test(rankable(predictions, "prediction"), sample=SAMPLE)

    @cached_property
    def tree_models(self) -> dict[str, Model]:
        return {}

    def tree_model(self, kind: str) -> Model:
        if kind not in self.tree_models:
            rows = self.binned[1]
            settled = models.settled(rows, ["permno", "date", "gvkey"]) if kind == "rf" else rows
            self.tree_models[kind] = models.tree(kind).fit(settled)
        return self.tree_models[kind]

    def tree_predictions(self, *kinds: str, names: tuple[str, ...] = modelling.TEST_SAMPLES) -> DataFrame:
        return modelling.predict_all({k: self.tree_model(k) for k in kinds}, self.full, self.binned[0], SAMPLE, names)

    def tree_back_test(self, *kinds: str) -> dict[str, DataFrame]:
        predictions = durable(self.tree_predictions(*kinds, names=modelling.DISJOINT), "trees").drop("sample")
        return backtest.back_test(rankable(predictions, "prediction"), by=["model"], sample=SAMPLE)

    def legs(self, model_returns: DataFrame, model_legs: dict[str, tuple[str, int]]) -> DataFrame:
        """Monthly value-weighted out-of-sample return of one group per strategy."""
        chosen = {"momentum": ("by_momentum_12", 10), "size": ("by_size", 1), "value": ("by_value", 1), **model_legs}
        returns = self.portfolios(*SORTED).unionByName(
            model_returns.where(F.col("sample") == "out").drop("sample")
        )
        picked = performance.pick_legs(returns, chosen)
        return picked.where(portfolios.month_end() > F.lit(SAMPLE.validation_end).cast("date"))

    def ols_legs(self) -> DataFrame:
        s = self.sharing(CORE_SIGNALS)
        returns = s.ols_back_test()["returns"].withColumn("signal", F.lit("ols"))
        return s.legs(returns, {"ols": ("ols", 10)})

    def tree_legs(self) -> DataFrame:
        s = self.sharing(ALL_SIGNALS)
        returns = s.tree_back_test("rf", "gbt")["returns"].withColumnRenamed("model", "signal")
        return s.legs(returns, {"random_forest": ("rf", 10), "boosted_trees": ("gbt", 10)})


def rankable(df: DataFrame, signal: str) -> DataFrame:
    """The signal without its last bits, which would otherwise decide ranks."""
    return df.withColumn(signal, F.round(signal, RANK_DIGITS))


def _macro(s: Study) -> DataFrame:
    joined = macro.join_macro(
        s.months.select("permno", "date", "year", "month"), star_schema.macro_file(s.table("orders")), SAMPLE.end, list(SERIES)
    )
    return joined.withColumnsRenamed(SERIES)


def _macro_daily(s: Study) -> DataFrame:
    joined = macro.join_macro(
        s.months.select("permno", "date", "year", "month"), star_schema.macro_daily(s.table("orders")), SAMPLE.end, list(SERIES)
    )
    return joined.withColumnsRenamed(SERIES)


def _coerced(s: Study) -> DataFrame:
    raw = star_schema.coded_file(s.table("lineitem"))
    keys = StructType([StructField("line_key", LongType()), StructField("line", LongType()), *star_schema.CODED])
    return typed(raw, keys)


def _panel_store(s: Study) -> DataFrame:
    """Momentum over a stored panel of which one year was restated, at twice its prices."""
    path = new_path(s.spark, "panel")
    months = s.months.select("permno", "date", "prc", "ret", "year")
    name = f"panel_{path[-32:]}"
    open_panel(s.spark, name, path, months, STORE_BUCKETS)
    replace_years(s.spark, name, months, STORE_BUCKETS)
    restated = s.spark.table(name).where("year = 1998").withColumn("prc", F.col("prc") * 2)
    replace_years(s.spark, name, durable(restated, "restated"), STORE_BUCKETS)
    return signals.momentum(s.spark.table(name))


def _panel_append(s: Study) -> DataFrame:
    """The months after the training sample, appended in two steps to the state of those before."""
    dated = s.raw.withColumn("step", sum(F.when(F.col("date") > F.lit(d).cast("date"), 1).otherwise(0) for d in APPEND_AFTER))
    raw = durable(dated, "raw")
    state, panels_found = append.first_state(raw.where("step = 0").drop("step"), SAMPLE), []
    for step in range(1, len(APPEND_AFTER) + 1):
        found, state = append.append_months(state, raw.where(F.col("step") == step).drop("step"), s.factors, SAMPLE)
        panels_found.append(found)
    return reduce(DataFrame.unionByName, panels_found)


def _account_asof(s: Study) -> DataFrame:
    accounts = s.linked.withColumnRenamed("lpermno", "permno")
    taken = {"account_date": "datadate", "gvkey": "gvkey", "be": "be"}
    return asof_join(s.months.select("permno", "date"), accounts, ["permno"], "date", "datadate", taken, ["gvkey"])


def _any_period(s: Study) -> DataFrame:
    stored = durable(blocks.month_blocks(s.portfolios("momentum_12"), "equal_ret"), "blocks")
    return blocks.period_stats(stored, ANY_PERIOD)


def _stump_rows(s: Study) -> DataFrame:
    """Training months with the one signal that has few distinct values, in a fixed layout."""
    months = signals.momentum_count(s.months).select("permno", "date", "momentum_count", F.round("ret", 6).alias("ret"))
    rows = splits.with_features(months.na.drop().where(F.col("date") <= F.lit(SAMPLE.train_end).cast("date")), ["momentum_count"])
    return durable(models.settled(rows, ["permno", "date"]), "stump")


def _stump(s: Study, kind: str, **params) -> DataFrame:
    """Prediction by the signal's value, and the fit's accuracy on its rows."""
    rows = _stump_rows(s)
    fitted = models.tree(kind, maxDepth=1, **params).fit(rows).transform(rows)
    r2 = models.evaluate(fitted).select("r2").scalar()
    return fitted.groupBy("momentum_count").agg(F.avg("prediction").alias("prediction")).withColumn("r2", r2)


def _extra(s: Study) -> DataFrame:
    return linking.join_fundamental_extra(s.accounts, star_schema.fundamental_extra(s.accounts))


def _lookup(s: Study) -> DataFrame:
    poor = s.table("supplier").where(F.col("s_acctbal") < 1000).select(F.col("s_suppkey").alias("permno"))
    return profiling.securities(s.clean, poor, ["permno", "date", "prc", "ret", "me"])


def _joined(s: Study, dedupe: bool) -> DataFrame:
    months = cleaning.require(s.months, ["ret"])
    return linking.join_fundamentals(months, s.linked, dedupe)


def _onehot(s: Study) -> DataFrame:
    bits = F.transform(vector_to_array("industry_vector"), lambda x: x.cast("int").cast("string"))
    coded = models.encode_category(s.industries, "industry", "industry_index", "industry_vector")
    return coded.withColumn("onehot", F.array_join(bits, ""))


def _cumulative(s: Study) -> DataFrame:
    returns = s.portfolios("momentum_12").withColumnRenamed("equal_ret", "ret")
    return portfolios.cumulative_return(returns, "ret")


def _market(s: Study, weighting: str) -> DataFrame:
    return benchmarks.market_paths(s.research, WHOLE_AND_RECENT).where(F.col("weighting") == weighting)


def _out_performance(s: Study) -> DataFrame:
    out = portfolios.subsamples(s.portfolios("momentum_12"), {"out": STARTS["out"]})
    return performance.performance_stats(out, "value_ret")


def _strategy_wealth(s: Study) -> DataFrame:
    paths = portfolios.cumulative_return(s.ols_legs(), "ret", ["strategy"])
    return performance.compare_legs(paths, ["momentum", "size", "value", "ols"], "wealth")


def _decision_trees(s: Study) -> DataFrame:
    bins, train = modelling.binned_train(s.core, CORE_SIGNALS, SAMPLE)
    sparse = {f"{kind}_core": models.tree(kind).fit(train) for kind in ("dt", "gbt")}
    columns = ["model", "sample", "permno", "date", "gvkey", "ret", "prediction"]
    return modelling.predict_all(sparse, s.core, bins, SAMPLE, ["validation"]).select(columns).unionByName(
        s.tree_predictions("dt", names=("validation",)).select(columns)
    )


def _depth_two(s: Study) -> DataFrame:
    """A tree of two levels on exact bins, scored on the validation rows."""
    rounded = {c: F.round(c, RANK_DIGITS) for c in CORE_SIGNALS} | {"ret": F.round("ret", 6)}
    rows = s.core.withColumns(rounded)
    bins, train = modelling.binned_train(rows, CORE_SIGNALS, SAMPLE)
    fitted = models.tree("dt", maxDepth=2).fit(train)
    return modelling.predict_all({"dt": fitted}, rows, bins, SAMPLE, ["validation"])


def _tree_metrics(s: Study) -> DataFrame:
    s = s.sharing(ALL_SIGNALS)
    columns = ["model", "sample", "ret", "prediction"]
    scored = _decision_trees(s).select(columns)
    both = s.tree_predictions("rf", "gbt").where("model = 'rf' OR sample = 'validation'")
    return models.evaluate(scored.unionByName(both.select(columns)), by=["model", "sample"])


def _grid(s: Study, penalties: dict[str, float]) -> DataFrame:
    fits = {name: s.linear(reg) for name, reg in penalties.items()}
    found = gram.accuracy_table(s.spark, fits, {"validation": s.core_statistics["validation"]})
    return found.withColumnRenamed("model", "setting")


def _linear_accuracy(s: Study, *names: str) -> DataFrame:
    return gram.accuracy_table(s.spark, {"ols": s.linear()}, {n: s.core_statistics[n] for n in names})


def _by_month(s: Study) -> DataFrame:
    months = gram.monthly_statistics(s.core, ["momentum_12"])
    terms = gram.expanding_table(s.spark, months).groupBy("date", "n", "r2").pivot("term", ["intercept", "momentum_12"]).agg(F.first("estimate"))
    return terms.withColumnRenamed("momentum_12", "slope")


def _feature_matrix(s: Study) -> DataFrame:
    return splits.label_samples(splits.feature_set(s.research, ALL_SIGNALS, extra_keys=backtest.ROW_KEY), SAMPLE)


BUILDERS: dict[str, Callable[[Study], DataFrame]] = {
    # Sources
    "scan_panel": lambda s: s.raw,
    "factor_series": lambda s: s.factors,
    "macro_join": _macro,
    "macro_join_daily": _macro_daily,
    "code_coercion": _coerced,
    "rejects": lambda s: ingest(star_schema.coded_file(s.table("lineitem")), star_schema.CODED, "coded", keys=["permno"])[1],
    "fund_extra_join": _extra,
    "panel_store": _panel_store,
    "panel_append": _panel_append,
    "account_asof": _account_asof,
    "any_period": _any_period,
    # Projections and predicates
    "clean_returns": lambda s: cleaning.clean_price(cleaning.clean_returns(s.raw)),
    "market_equity": lambda s: s.clean,
    "calendar_cols": lambda s: s.clean,
    "universe_filter": lambda s: cleaning.require(s.months, ["ret"]),
    "link_filter": lambda s: linking.valid_links(s.links),
    "penny_filter": lambda s: cleaning.min_price(s.months, 2400),
    "security_lookup": _lookup,
    "industry_map": lambda s: s.months,
    "liquidity": lambda s: signals.turnover(signals.dollar_volume(s.months)),
    "excess_return": lambda s: s.with_factors,
    "book_equity": lambda s: fundamentals.book_equity(s.accounts),
    "current_ratio": lambda s: fundamentals.current_ratio(s.accounts),
    "value_factor": lambda s: fundamentals.value_factor(linking.join_fundamentals(cleaning.require(s.sized, ["ret"]), s.linked)),
    "price_ratios": lambda s: fundamentals.price_ratios(_joined(s, dedupe=False)),
    "complete_cases": lambda s: splits.feature_set(s.research, CORE_SIGNALS, extra_keys=backtest.ROW_KEY),
    # Joins
    "factor_join": lambda s: signals.join_factors(s.months, s.factors),
    "link_join": lambda s: linking.link_fundamentals(s.accounts, s.links, SAMPLE.as_of),
    "fundamental_join": lambda s: _joined(s, dedupe=False),
    "fundamental_join_latest": lambda s: _joined(s, dedupe=True),
    # Windows
    "lagged_cols": lambda s: cleaning.with_lag(s.clean.drop("prc_lag"), ["prc", "ret", "me"]),
    "momentum": lambda s: signals.momentum(s.months),
    "reversal": lambda s: signals.reversal(s.months),
    "momentum_count": lambda s: signals.momentum_count(s.months),
    "rolling_vol": lambda s: signals.rolling_vol(s.with_factors),
    "rolling_corr": lambda s: signals.rolling_corr(s.with_factors),
    "beta": lambda s: signals.beta(s.with_factors),
    "size_factor": lambda s: s.sized,
    "growth_rates": lambda s: s.linked,
    "rd_growth_lags": lambda s: s.linked,
    "total_mktcap": lambda s: signals.total_mktcap(s.sized),
    "value_weights": lambda s: signals.value_weights(durable(s.sized.select("permno", "date", "size"), "sizes")),
    # Quantiles and portfolios
    "decile_momentum": lambda s: s.deciles("momentum_12"),
    "decile_size": lambda s: s.deciles("size"),
    "decile_value": lambda s: s.deciles("value"),
    "decile_value_present": lambda s: s.deciles("value", drop_missing=True),
    "portfolio_momentum": lambda s: s.portfolios("momentum_12"),
    "portfolio_size": lambda s: s.portfolios("size"),
    "portfolio_value": lambda s: s.portfolios("value"),
    "portfolio_beta": lambda s: s.portfolios("beta_lag"),
    "decile_matrix": lambda s: portfolios.to_matrix(s.portfolios("momentum_12"), "equal_ret"),
    "cumulative_return": _cumulative,
    "subsample_cum": lambda s: backtest.sample_wealth(s.portfolios("momentum_12"), STARTS),
    "subperiod_terminal": lambda s: portfolios.terminal_wealth(s.portfolios("beta_lag"), PERIODS, "equal_ret"),
    "market_equal": lambda s: _market(s, "equal"),
    "market_value": lambda s: _market(s, "value"),
    "factor_benchmark": lambda s: benchmarks.factor_paths(s.factors, WHOLE_AND_RECENT),
    "performance_stats": _out_performance,
    "strategy_compare": lambda s: performance.compare_legs(s.ols_legs(), ["momentum", "size", "value", "ols"]),
    "strategy_wealth": _strategy_wealth,
    "strategy_stats": lambda s: performance.performance_stats(s.ols_legs(), "ret", ["strategy"]),
    # Profiles
    "profile_nulls": lambda s: profiling.null_counts(s.plain, PROFILED),
    "profile_stats": lambda s: profiling.summary(s.unweighted, ["prc", "ret", "ex_ret"]),
    "industry_distinct": lambda s: profiling.distinct_values(s.indexed, ["industry", "industry_index"]),
    "top_returns": lambda s: profiling.top_returns(cleaning.require(s.months, ["ret"])),
    # Samples, features, models
    "time_split": lambda s: splits.label_samples(s.plain, SAMPLE),
    "industry_index": lambda s: s.indexed,
    "industry_onehot": _onehot,
    "feature_matrix": _feature_matrix,
    "ols_coefficients": lambda s: s.linear_terms(),
    "ols_train_metrics": lambda s: _linear_accuracy(s, "train"),
    "ols_predict": lambda s: s.ols_predictions,
    "ols_inference": lambda s: gram.inference_table(s.spark, CORE_SIGNALS, s.core_statistics["train"]),
    "evaluate_ols": lambda s: _linear_accuracy(s, *modelling.TEST_SAMPLES),
    "decile_prediction": lambda s: assign_quantile(
        rankable(s.linear_predictions(names=("validation", "out")), "prediction"),
        "prediction", tie_break=backtest.ROW_KEY,
    ),
    "prediction_matrix": lambda s: portfolios.to_matrix(s.ols_back_test()["prediction"], "prediction", index=["sample", "date"]),
    "backtest_lr": lambda s: s.ols_back_test()["wealth"],
    "ridge_coefficients": lambda s: s.linear_terms(0.3),
    "ridge_predict": lambda s: s.linear_predictions(0.3, ("validation",)),
    "ridge_grid": lambda s: _grid(s, {f"{reg:g}": reg for reg in RIDGE_GRID}),
    "glm_coefficients": lambda s: models.coefficients(
        models.generalized_linear(0.3).fit(s.train(s.core, CORE_SIGNALS)), CORE_SIGNALS, s.research
    ),
    "glm_grid": lambda s: _grid(s, {"gaussian": 0.5}),
    "linear_by_month": _by_month,
    "dt_stump": lambda s: _stump(s, "dt"),
    "rf_stump": lambda s: _stump(s, "rf", numTrees=1, featureSubsetStrategy="all", bootstrap=False),
    "gbt_stump": lambda s: _stump(s, "gbt", maxIter=2, stepSize=0.1),
    "dt_depth2": _depth_two,
    "tree_predict": _decision_trees,
    "rf_predict": lambda s: s.tree_predictions("rf"),
    "gbt_predict": lambda s: s.tree_predictions("gbt"),
    "rf_importance": lambda s: models.importances(s.tree_model("rf"), ALL_SIGNALS, s.research),
    "gbt_importance": lambda s: models.importances(s.tree_model("gbt"), ALL_SIGNALS, s.research),
    "tree_metrics": _tree_metrics,
    "backtest_rf": lambda s: s.tree_back_test("rf")["wealth"],
    "backtest_gbt": lambda s: s.tree_back_test("gbt")["wealth"],
    "strategy_compare_models": lambda s: performance.compare_legs(
        s.tree_legs(), ["momentum", "size", "value", "random_forest", "boosted_trees"]
    ),
    "strategy_stats_models": lambda s: performance.performance_stats(s.tree_legs(), "ret", ["strategy"]),
}


def run(key: str, spark: SparkSession, folder: str) -> DataFrame:
    return spark_output(key, BUILDERS[key](Study(spark, folder)))
