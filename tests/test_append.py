"""Months appended to a state give the panel that all months together give."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.plans import append, panel
from panelforge.settings import Sample
from panelforge.storage import durable

SAMPLE = Sample("2001-01-01", "2003-12-31", "2004-12-31", "2006-01-01", "2008-12-31", "2008-12-31")
RAW = "permno long, permco long, date date, vol double, prc double, shrcd int, exchcd int, siccd int, shrout double, ret string"
SIGNALS = [
    "prc_lag", "ret", "dvol", "turn", "momentum_12", "momentum_6", "momentum_36", "momentum_count", "reversal", "size", "stock_sd", "mkt_sd", "corr",
    "beta", "beta_lag", "beta_shrink_lag_square", "weight_mktcap",
]


def month_end(i):
    return dt.date(2000 + (i + 1) // 12, (i + 1) % 12 + 1, 1) - dt.timedelta(days=1)


@pytest.fixture(scope="module")
def raw(spark):
    """96 months: full histories, gaps, late starts, an end and a return, months outside the universe, missing values."""
    rng, rows = random.Random(31), []
    for permno in range(1, 13):
        for i in range(96):
            if (permno == 3 and 40 <= i < 80) or (permno == 4 and i < 86) or (permno == 5 and i > 60) or (permno == 6 and rng.random() < 0.3):
                continue
            outside = permno == 7 and i % 9 == 0
            ret = rng.choice(["B", "-99", None]) if rng.random() < 0.05 else f"{rng.gauss(0.01, 0.08):.6f}"
            price = None if rng.random() < 0.03 else rng.choice([-1, 1]) * rng.uniform(5, 80)
            rows.append((permno, permno, month_end(i), rng.uniform(1, 9), price, 12 if outside else 10, 1, 100 * permno, rng.uniform(1, 5), ret))
    rows += [(None, 1, month_end(90), 1.0, 2.0, 10, 1, 100, 1.0, "0.1"), (1, 1, None, 1.0, 2.0, 10, 1, 100, 1.0, "0.1")]
    return durable(spark.createDataFrame(rows, RAW), "raw")


@pytest.fixture(scope="module")
def factors(spark):
    rng = random.Random(5)
    rows = [(month_end(i).year, month_end(i).month, rng.gauss(0, 0.05), 0.002) for i in range(96)]
    return durable(spark.createDataFrame(rows, "year int, month int, mkt_rf double, rf double"), "factors")


def after(i):
    return F.col("date") > F.lit(month_end(i))


def until(i):
    return ~after(i) | F.col("date").isNull()


def by_key(df):
    rows = {(r["permno"], r["date"]): r for r in df.select("permno", "date", *SIGNALS).collect()}
    assert len(rows) == df.count()
    return rows


def assert_same(found, wanted):
    assert found.keys() == wanted.keys() and wanted
    for key, row in wanted.items():
        for name in SIGNALS:
            a, b = found[key][name], row[name]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)), (key, name, a, b)


@pytest.mark.parametrize("cuts", [(83, 95), (83, 84, 85, 95), (-1, 50, 95)])
def test_appended_months_equal_all_months(spark, raw, factors, cuts):
    whole = by_key(panel.security_panel(raw, factors, SAMPLE).where(after(cuts[0])))
    state, found = append.first_state(raw.where(until(cuts[0])), SAMPLE), {}
    for low, high in zip(cuts[:-1], cuts[1:]):
        rows, state = append.append_months(state, raw.where(after(low) & until(high)), factors, SAMPLE)
        found |= by_key(rows)
    assert_same(found, whole)
    assert state.months.groupBy("permno").count().agg(F.max("count")).first()[0] <= append.REACH
    assert state.latest.count() == state.latest.select("permno").distinct().count() == 12


def test_only_state_and_new_months_are_read(spark, raw, factors, tmp_path):
    append.first_state(raw.where(until(83)), SAMPLE).write(f"{tmp_path}/state")
    raw.where(after(83)).write.parquet(f"{tmp_path}/new")
    state = append.read_state(spark, f"{tmp_path}/state")
    rows, _ = append.append_months(state, spark.read.parquet(f"{tmp_path}/new"), factors, SAMPLE, weights=False)
    read = {f.split("?")[0] for f in rows.inputFiles()}
    old = set(raw.inputFiles())
    assert not read & old and any("/state/months/" in f for f in read)
    wanted = panel.security_panel(raw, factors, SAMPLE).where(after(83))
    assert {k[:2] for k in by_key(wanted)} == {(r["permno"], r["date"]) for r in rows.collect()}


def test_rows_of_known_months_are_left_out_and_nothing_changes_nothing(spark, raw, factors):
    state = append.first_state(raw.where(until(83)), SAMPLE)
    again = raw.where(after(81)).withColumn("prc", F.when(after(83), F.col("prc")).otherwise(F.lit(1e6)))
    rows, later = append.append_months(state, again, factors, SAMPLE)
    assert_same(by_key(rows), by_key(panel.security_panel(raw, factors, SAMPLE).where(after(83))))
    none, same = append.append_months(later, raw.limit(0), factors, SAMPLE)
    assert none.count() == 0

    def content(df):
        return sorted(map(str, df.collect()))

    assert content(same.months) == content(later.months) and content(same.latest) == content(later.latest)
