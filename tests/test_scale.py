"""The same results when nothing is small enough to broadcast and when one key holds a third of all rows."""

import math
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from checks import study
from panelforge.operators import linking, signals
from panelforge.operators.quantiles import assign_quantile

FOLDER = "/root/testdata/sf0.001"
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
SPLIT_SKEW = {
    **NO_BROADCAST,
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def rows(df):
    def exact(x):
        return round(x, 8) if isinstance(x, float) and math.isfinite(x) else x

    return sorted((tuple(exact(x) for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("key", ["portfolio_value", "macro_join", "value_weights", "link_join", "fundamental_join_latest"])
def test_shuffle_joins_give_the_same_rows(spark, key):
    want = rows(study.run(key, spark, FOLDER))
    with settings(spark, NO_BROADCAST):
        df = study.run(key, spark, FOLDER)
        assert rows(df) == want
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_company_with_a_third_of_the_panel_is_split(spark):
    n = 30000
    panel = spark.range(n, numPartitions=16).selectExpr("id AS permno", "if(id % 3 = 0, 5L, id) AS permco", "2000 AS fyear", "hex(id) AS payload")
    comp = spark.range(n).selectExpr("id AS gvkey", "id AS lpermno", "id AS lpermco", "2000 AS fyear", "date'2000-12-31' AS datadate", "1.0D AS be")
    with settings(spark, SPLIT_SKEW):
        df = linking.join_fundamentals(panel, comp)
        got = df.agg(F.count("*"), F.sum("permno"), F.sum("gvkey")).first()
        kept = df.select("permno", "gvkey")
        kept.collect()
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    hot = n // 3
    assert tuple(got) == (n, n * (n - 1) // 2, 5 * hot + sum(i for i in range(n) if i % 3))


def test_a_date_with_a_third_of_the_rows_spreads_over_tasks(spark, monkeypatch):
    from panelforge.operators import quantiles

    stored = {}
    real = quantiles.durable
    monkeypatch.setattr(quantiles, "durable", lambda df, label: stored.setdefault(label, real(df, label)))
    df = spark.range(40000, numPartitions=16).selectExpr(
        "id AS permno", "if(id % 3 = 0, 0, id % 50) AS date", "if(id % 2 = 0, NULL, 1.0D) AS signal"
    )
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = assign_quantile(df, "signal", 10)
    sizes = got.where("date = 0").groupBy("grp").count()
    assert sizes.agg(F.max("count") - F.min("count")).first()[0] <= 1
    hot = stored["ranked"].where("date = 0")
    assert hot.select(F.shiftright("sort_pos", 33).alias("task")).distinct().count() >= 2
    total = hot.count()
    largest = hot.groupBy(F.shiftright("sort_pos", 33)).count().agg(F.max("count")).first()[0]
    assert largest < total * 0.75


def test_totals_are_summed_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("date'2000-01-31' AS date", "1.0D AS size")
    assert "partial_sum" in signals.total_mktcap(df)._jdf.queryExecution().executedPlan().toString()
