"""Output columns of every query, shared by the Spark side and the SQL side.

``name`` is passed on (exact in both engines), ``name:6`` is rounded to six digits, ``name:d`` is a date as text and
``name:i`` a whole number. Adding zero turns a negative zero into zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "permno date:d"
ROW = "permno date:d gvkey"
MATRIX = "year month " + " ".join(f"g{i}:10" for i in range(1, 11))
PREDICTIONS = "sample date:d " + " ".join(f"g{i}:6" for i in range(1, 11))
PORTFOLIO = "grp year month equal_ret:10 value_ret:10"

COLUMNS = {
    "scan_panel": f"{KEY} permco shrcd exchcd siccd prc ret vol shrout",
    "factor_series": "date:d year month mkt_rf:8 rf:8 mkt:8",
    "macro_join": f"{KEY} urgent high medium unspecified low",
    "macro_join_daily": f"{KEY} urgent high medium unspecified low",
    "code_coercion": "line_key line permno shrcd:i prc",
    "account_asof": f"{KEY} account_date:d gvkey be:4",
    "any_period": "period grp n wealth:6 annual_return:4 annual_volatility:4",
    "rejects": "column rows nulls rejected",
    "panel_store": f"{KEY} year prc momentum_12:6",
    "panel_append": f"{KEY} prc_lag ret:6 momentum_12:6 momentum_36:6 momentum_count:i reversal:6 dvol:6 turn:6 size log_size:6 "
    "stock_sd:6 corr:6 beta:6 beta_lag:6 beta_shrink_lag:6 weight_mktcap:10",
    "dt_stump": "momentum_count:i prediction:8 r2:8",
    "rf_stump": "momentum_count:i prediction:8 r2:8",
    "gbt_stump": "momentum_count:i prediction:8 r2:8",
    "fund_extra_join": "gvkey datadate:d datafmt prba:4",
    "clean_returns": f"{KEY} ret:6 prc siccd",
    "market_equity": f"{KEY} me",
    "calendar_cols": f"{KEY} year month fdate:d fyear",
    "universe_filter": f"{KEY} shrcd exchcd ret:6",
    "link_filter": "gvkey lpermno lpermco linktype linkprim linkdt linkenddt",
    "penny_filter": f"{KEY} prc",
    "security_lookup": f"{KEY} prc ret:6 me",
    "industry_map": f"{KEY} siccd industry",
    "link_join": "gvkey datadate:d fyear lpermno lpermco linktype linkdt:d linkenddt:d at:4",
    "liquidity": f"{KEY} dvol:6 turn:6",
    "excess_return": f"{KEY} ex_ret:8",
    "beta": f"{KEY} beta:6 beta_shrink:6 beta_lag:6 beta_shrink_lag:6 beta_lag_square:3 beta_shrink_lag_square:3",
    "size_factor": f"{KEY} size log_size:6",
    "book_equity": "gvkey datadate:d she:4 dt:4 ps:4 be:4",
    "current_ratio": "gvkey datadate:d current_ratio:6",
    "value_factor": f"{ROW} value:6",
    "price_ratios": f"{ROW} ep:6 sp:6",
    "complete_cases": "permno date:d gvkey momentum_12:6 log_size:6 value:6 ret:6",
    "factor_join": f"{KEY} mkt_rf:8 rf:8",
    "fundamental_join": f"{ROW} permco fyear datadate:d be:4 ret:6",
    "fundamental_join_latest": f"{ROW} permco fyear datadate:d be:4 ret:6",
    "value_weights": f"{KEY} total_mktcap:2 weight_mktcap:9",
    "strategy_compare": "year month momentum:6 size:6 value:6 ols:6",
    "strategy_wealth": "year month momentum:6 size:6 value:6 ols:6",
    "lagged_cols": f"{KEY} prc_lag ret_lag:6 me_lag",
    "momentum": f"{KEY} momentum_12:6 momentum_6:6 momentum_36:6",
    "reversal": f"{KEY} reversal:6",
    "momentum_count": f"{KEY} momentum_count:i",
    "rolling_vol": f"{KEY} stock_sd:6 mkt_sd:6",
    "rolling_corr": f"{KEY} corr:6",
    "growth_rates": "gvkey datadate:d at_growth:6 revt_growth:6 ni_growth:6 xrd_growth:6",
    "rd_growth_lags": "gvkey datadate:d xrd_growth_lag1:6 xrd_growth_lag2:6",
    "decile_momentum": f"{ROW} grp",
    "decile_size": f"{ROW} grp",
    "decile_value": f"{ROW} grp",
    "decile_value_present": f"{ROW} grp",
    "decile_prediction": f"{ROW} grp",
    "cumulative_return": "grp year month ret:10 wealth:6",
    "total_mktcap": "date:d total_mktcap:2",
    "portfolio_momentum": PORTFOLIO,
    "portfolio_size": PORTFOLIO,
    "portfolio_value": PORTFOLIO,
    "portfolio_beta": PORTFOLIO,
    "backtest_lr": "sample weighting grp year month ret:10 wealth:8",
    "decile_matrix": MATRIX,
    "prediction_matrix": PREDICTIONS,
    "market_equal": "sample year month ret:12 wealth:6",
    "market_value": "sample year month ret:9 wealth:6",
    "factor_benchmark": "sample year month mkt:8 wealth:6",
    "subsample_cum": "sample weighting grp year month ret:10 wealth:6",
    "performance_stats": "grp annual_return:6 annual_volatility:6 sharpe:6",
    "strategy_stats": "strategy annual_return:6 annual_volatility:6 sharpe:6",
    "profile_nulls": "column rows nulls",
    "profile_stats": "column count mean:4 stddev:4 min:4 max:4",
    "industry_distinct": "industry industry_index:i",
    "subperiod_terminal": "period grp wealth:6",
    "top_returns": f"{KEY} prc ret:6",
    "time_split": f"sample {ROW} ret:6",
    "industry_index": f"{KEY} industry industry_index:i",
    "industry_onehot": f"{KEY} onehot",
    "feature_matrix": (
        "sample permno date:d gvkey momentum_12:6 momentum_count:i momentum_6:6 momentum_36:6 reversal:6 beta_lag:6 "
        "beta_shrink_lag:6 beta_lag_square:3 beta_shrink_lag_square:3 size log_size:6 revt:4 be:4 value:6 dvol:6 "
        "turn:6 ep:6 sp:6 at_growth:6 ni_growth:6 revt_growth:6 current_ratio:6 ret:6"
    ),
    "ols_coefficients": "term estimate:6",
    "ols_train_metrics": "n r2:6 rmse:6",
    "ols_predict": f"sample {ROW} prediction:6",
    "ols_inference": "term estimate:6 std_error:6 t_value:4",
    "ridge_coefficients": "term estimate:6",
    "ridge_grid": "setting r2:6 rmse:6",
    "glm_coefficients": "term estimate:6",
    "glm_grid": "setting r2:6 rmse:6",
    "linear_by_month": "date:d n intercept:6 slope:6 r2:6",
    "evaluate_ols": "sample n r2:6 rmse:6",
    "ridge_predict": f"sample {ROW} prediction:6",
    "dt_depth2": f"sample {ROW} prediction:8",
    "tree_predict": f"model sample {ROW} prediction:6",
    "gbt_predict": f"sample {ROW} prediction:6",
    "rf_predict": f"sample {ROW} prediction:6",
    "gbt_importance": "signal importance:6",
    "rf_importance": "signal importance:6",
    "tree_metrics": "model sample n r2:6 rmse:6",
    "backtest_rf": "sample weighting grp year month ret:10 wealth:6",
    "backtest_gbt": "sample weighting grp year month ret:10 wealth:6",
    "strategy_compare_models": "year month momentum:6 size:6 value:6 random_forest:6 boosted_trees:6",
    "strategy_stats_models": "strategy annual_return:6 annual_volatility:6 sharpe:6",
}


def _fields(key: str) -> list[tuple[str, str]]:
    return [(name, kind) for name, _, kind in (item.partition(":") for item in COLUMNS[key].split())]


def spark_output(key: str, df: DataFrame) -> DataFrame:
    def shaped(name: str, kind: str):
        column = F.col(f"`{name}`")
        if kind == "d":
            column = column.cast("string")
        elif kind == "i":
            column = column.cast("bigint")
        elif kind:
            column = F.round(column, int(kind)) + F.lit(0.0)
        return column.alias(name)

    return df.select(*[shaped(name, kind) for name, kind in _fields(key)])


def sql_output(key: str) -> str:
    def shaped(name: str, kind: str) -> str:
        if kind == "d":
            return f'CAST(CAST("{name}" AS DATE) AS VARCHAR) AS "{name}"'
        if kind == "i":
            return f'CAST("{name}" AS BIGINT) AS "{name}"'
        return f'round("{name}", {kind}) + 0.0 AS "{name}"' if kind else f'"{name}"'

    return ", ".join(shaped(name, kind) for name, kind in _fields(key))
