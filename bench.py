"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local threads.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from checks import study

HEADLINE = [
    "scan_panel", "clean_returns", "momentum", "beta", "liquidity", "value_weights",
    "link_join", "growth_rates", "fundamental_join", "fundamental_join_latest",
    "decile_momentum", "portfolio_momentum", "portfolio_size", "portfolio_value", "subsample_cum",
    "market_value", "strategy_stats", "profile_stats", "top_returns", "industry_index",
    "feature_matrix", "ols_coefficients", "evaluate_ols", "backtest_lr", "ridge_grid",
    "tree_predict", "rf_predict", "gbt_predict", "backtest_rf",
]


def timed(spark: SparkSession, key: str, folder: str) -> float:
    started = time.perf_counter()
    study.run(key, spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelforge-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="panelforge-bench-"))
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")  # one task per thread
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, "clean_returns", folder)  # start-up is not part of any query
    seconds = {key: timed(spark, key, folder) for key in HEADLINE}
    scale = Path(folder).name.removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
