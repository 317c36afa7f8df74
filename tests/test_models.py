import bisect
import math
import random
import re

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelforge.operators import binning, gram, models, splits
from panelforge.plans import modelling, study
from panelforge.settings import ALL_SIGNALS, CORE_SIGNALS, MODEL_KEYS, Sample

SIGNALS = ["a", "b", "c"]
SAMPLE = Sample("2000-01-01", "2000-04-30", "2000-08-31", "2000-10-01", "2000-12-31")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(600):
        a, b, c = rng.gauss(0, 1), rng.gauss(5, 2), rng.uniform(0, 9)
        out.append((i // 50, i, a, b, c, 0.3 * a - 0.1 * b + 0.05 * c + rng.gauss(0, 0.4)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, "m int, permno int, a double, b double, c double, ret double")
    return df.selectExpr("*", "last_day(add_months(date'2000-01-01', m)) AS date").cache()


def closed_form(rows, reg):
    x = np.array([r[2:5] for r in rows]); y = np.array([r[5] for r in rows])
    sx, sy = x.std(axis=0), y.std()
    z, yc = (x - x.mean(axis=0)) / sx, y - y.mean()
    slopes = np.linalg.solve(z.T @ z / len(y) + np.eye(3) * reg / sy, z.T @ yc / len(y)) / sx
    return [y.mean() - slopes @ x.mean(axis=0), *slopes]


@pytest.mark.parametrize("reg", [0.0, 0.3, 10.0])
def test_linear_models_match_the_closed_form(table, rows, reg):
    train = splits.with_features(table, SIGNALS)
    for estimator in (models.linear(reg), models.generalized_linear(reg)):
        got = {r["term"]: r["estimate"] for r in models.coefficients(estimator.fit(train), SIGNALS, train).collect()}
        assert [got[t] for t in ("intercept", *SIGNALS)] == pytest.approx(closed_form(rows, reg), rel=1e-6)


def student_p(t, df):
    """Two-sided tail of Student's t by the trapezoid rule."""
    grid = np.linspace(abs(t), abs(t) + 400, 2_000_001)
    density = (1 + grid**2 / df) ** (-(df + 1) / 2)
    whole = np.linspace(-400, 400, 2_000_001)
    return 2 * np.trapezoid(density, grid) / np.trapezoid((1 + whole**2 / df) ** (-(df + 1) / 2), whole)


def test_inference_table(table, rows):
    train = splits.with_features(table.where("permno < 40"), SIGNALS)
    got = {r["term"]: r for r in models.inference(models.linear().fit(train), SIGNALS, train).collect()}
    x = np.array([[1, *r[2:5]] for r in rows[:40]]); y = np.array([r[5] for r in rows[:40]])
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    s2 = ((y - x @ beta) ** 2).sum() / (40 - 4)
    error = np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x)))
    for i, term in enumerate(["intercept", *SIGNALS]):
        assert got[term]["std_error"] == pytest.approx(error[i], rel=1e-8)
        assert got[term]["t_value"] == pytest.approx(beta[i] / error[i], rel=1e-8)
        assert got[term]["p_value"] == pytest.approx(student_p(beta[i] / error[i], 36), abs=1e-5)


def test_evaluate_equals_the_evaluator(table):
    scored = table.withColumn("prediction", F.col("a") * 0.2 - 0.3)
    got = models.evaluate(scored).first()
    for metric in ("r2", "rmse"):
        want = RegressionEvaluator(labelCol="ret", predictionCol="prediction", metricName=metric).evaluate(scored)
        assert got[metric] == pytest.approx(want, rel=1e-9)
    by_month = models.evaluate(scored, by=["m"])
    assert by_month.count() == 12 and by_month.agg(F.sum("n")).first()[0] == 600


def test_grid_scores_on_the_later_sample(table):
    featured = splits.with_features(table, SIGNALS)
    train, validation = (splits.time_split(featured, SAMPLE)[n] for n in ("train", "validation"))
    got = {r["setting"]: r for r in models.grid_evaluate({"0": models.linear(), "9": models.linear(9.0)}, train, validation).collect()}
    assert got["0"]["r2"] > got["9"]["r2"]
    alone = models.evaluate(models.linear(9.0).fit(train).transform(validation)).first()
    assert (got["9"]["r2"], got["9"]["rmse"]) == pytest.approx((alone["r2"], alone["rmse"]))


def test_samples_are_disjoint_but_for_the_recent_tail(table):
    parts = {n: {r["permno"] for r in d.collect()} for n, d in splits.time_split(table, SAMPLE).items()}
    assert len(parts["train"]) == 200 and len(parts["validation"]) == 200 and len(parts["out"]) == 200
    assert not parts["train"] & parts["validation"] and not parts["validation"] & parts["out"]
    assert parts["recent"] < parts["out"] and len(parts["recent"]) == 150
    labelled = splits.label_samples(table, SAMPLE).groupBy("sample").count().collect()
    assert {r["sample"]: r["count"] for r in labelled} == {n: len(p) for n, p in parts.items()}


def test_feature_set_names_each_column_once(spark):
    columns = list(dict.fromkeys([*ALL_SIGNALS, *MODEL_KEYS]))
    values = ", ".join("date'2000-01-31' AS date" if c == "date" else f"1.0D AS {c}" for c in columns)
    df = spark.sql(f"SELECT {values}, CAST(NULL AS LONG) AS gvkey")
    got = splits.feature_set(df, ALL_SIGNALS, extra_keys=["gvkey"])
    assert got.columns == [*columns, "gvkey"] and got.count() == 1
    assert splits.with_features(got, ALL_SIGNALS).first()["features"].size == len(ALL_SIGNALS) == 22
    assert set(CORE_SIGNALS) < set(ALL_SIGNALS)


def test_decision_tree_predicts_leaf_means(table):
    train = models.settled(splits.with_features(table, SIGNALS), ["permno"])
    model = models.tree("dt", leafCol="leaf").fit(train)
    leaves = model.transform(train).groupBy("leaf").agg(F.avg("ret").alias("mean"), F.max("prediction").alias("p"), F.min("prediction").alias("q"))
    for r in leaves.collect():
        assert r["p"] == r["q"] == pytest.approx(r["mean"], abs=1e-9)


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_forests_repeat_and_weigh_signals(table, kind):
    train = models.settled(splits.with_features(table, SIGNALS), ["permno"])
    model = models.tree(kind).fit(train)
    weights = {r["signal"]: r["importance"] for r in models.importances(model, SIGNALS, train).collect()}
    assert sum(weights.values()) == pytest.approx(1.0) and min(weights.values()) >= 0
    # Same rows from another layout: the fixed partitions and order make the fit the same.
    again = models.tree(kind).fit(models.settled(splits.with_features(table.repartition(13, "ret"), SIGNALS), ["permno"]))
    assert list(model.featureImportances.toArray()) == pytest.approx(list(again.featureImportances.toArray()), abs=1e-9)
    # A boosted or bagged fit beats the mean on its own rows.
    assert models.evaluate(model.transform(train)).first()["r2"] > 0.3


@pytest.mark.parametrize("kind", ["dt", "rf", "gbt"])
def test_fits_do_not_depend_on_the_cluster_setting(spark, kind):
    rows = spark.range(20_000).selectExpr("id AS permno", "sin(id) AS a", "cos(id * 3) AS b", "sin(id) * 2 + cos(id) AS ret")
    before, weights = spark.conf.get("spark.sql.shuffle.partitions"), []
    params = {"maxDepth": 3} | ({"maxIter": 2} if kind == "gbt" else {"numTrees": 3} if kind == "rf" else {})
    for setting in ("3", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", setting)
        train = models.settled(splits.with_features(rows, ["a", "b"]), ["permno"])
        weights.append(list(models.tree(kind, **params).fit(train).featureImportances.toArray()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert weights[0] == pytest.approx(weights[1], abs=1e-9)


def test_a_security_with_many_rows_is_spread_and_the_count_is_the_callers(spark):
    rows = spark.range(20_000).selectExpr("IF(id % 3 = 0, -1, id) AS permno", "date_add(date'1950-01-01', int(id)) AS date")
    for partitions in (16, 40):
        dealt = models.settled(rows, ["permno", "date"], partitions).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) == partitions
        assert max(r["count"] for r in dealt) < 1.5 * 20_000 / partitions


def test_unknown_tree_is_refused():
    with pytest.raises(ValueError):
        models.tree("oak")


def test_predictions_are_stacked_by_sample(table):
    samples = modelling.model_samples(table, SIGNALS, SAMPLE)
    fits = {"a": models.linear().fit(samples["train"]), "b": models.linear(9.0).fit(samples["train"])}
    got = modelling.predict_all(fits, table, SIGNALS, SAMPLE)
    assert {(r["model"], r["sample"]): r["count"] for r in got.groupBy("model", "sample").count().collect()} == {
        (m, s): n for m in "ab" for s, n in (("validation", 200), ("out", 200), ("recent", 150))
    }
    assert got.drop("model", "sample", "prediction").columns == table.columns
    want = fits["b"].transform(samples["out"]).agg(F.sum("prediction")).first()[0]
    assert got.where("model = 'b' AND sample = 'out'").agg(F.sum("prediction")).first()[0] == pytest.approx(want)
    plain = gram.Linear(float(fits["b"].intercept), tuple(fits["b"].coefficients))
    linear = modelling.predict_linear({"b": plain}, table, SIGNALS, SAMPLE, ["out"])
    assert linear.agg(F.sum("prediction")).first()[0] == pytest.approx(want) and linear.count() == 200


def test_all_models_and_samples_come_from_one_scan(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    fits = {name: models.linear(reg).fit(modelling.model_samples(stored, SIGNALS, SAMPLE)["train"]) for name, reg in (("a", 0.0), ("b", 1.0))}
    for scored in (modelling.predict_all(fits, stored, SIGNALS, SAMPLE), gram.month_statistics(stored, SIGNALS)):
        assert scored._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    jobs = spark._jsc.sc().statusTracker()
    spark.sparkContext.setJobGroup("linear", "linear")
    results = study.linear_results(stored.withColumnsRenamed(dict(zip(SIGNALS, CORE_SIGNALS))), SAMPLE)
    ran = len(jobs.getJobIdsForGroup("linear"))
    spark.sparkContext.setJobGroup("other", "other")
    assert ran <= 2  # the stages of one aggregate
    assert results["grid"].count() == 5


@pytest.mark.parametrize("reg", [0.0, 0.3, 10.0])
def test_month_statistics_give_the_closed_form(table, rows, reg):
    months = gram.monthly_statistics(table, SIGNALS)
    whole = gram.fit(months.span(), reg)
    assert [whole.intercept, *whole.slopes] == pytest.approx(closed_form(rows, reg), rel=1e-9)
    parts = months.samples(SAMPLE)
    assert {n: s.n for n, s in parts.items()} == {"train": 200, "validation": 200, "out": 200, "recent": 150}
    model = gram.fit(parts["train"], reg)
    for name, stats in parts.items():
        scored = splits.time_split(table, SAMPLE)[name].withColumn("prediction", model.prediction(SIGNALS))
        want = models.evaluate(scored).first()
        assert gram.accuracy(stats, model) == pytest.approx((want["n"], want["r2"], want["rmse"]), rel=1e-9)


def test_statistics_inference_equals_the_library(spark, table):
    train = splits.with_features(table.where("permno < 40"), SIGNALS)
    want = {r["term"]: r for r in models.inference(models.linear().fit(train), SIGNALS, train).collect()}
    got = {r["term"]: r for r in gram.inference_table(spark, SIGNALS, gram.monthly_statistics(train, SIGNALS).span()).collect()}
    for term, row in want.items():
        assert tuple(got[term])[1:] == pytest.approx(tuple(row)[1:], rel=1e-6, abs=1e-12)


def test_statistics_of_odd_rows(spark, table):
    odd = table.selectExpr("date", "IF(permno = 3, NULL, a) AS a", "IF(permno = 4, double('NaN'), b) AS b", "7.0D AS c", "ret")
    months = gram.monthly_statistics(odd, SIGNALS)
    assert months.span().n == 598
    model = gram.fit(months.span())
    assert model.slopes[2] == 0
    kept = odd.na.drop().drop("c")
    assert model.slopes[:2] == pytest.approx(gram.fit(gram.monthly_statistics(kept, ["a", "b"]).span()).slopes)
    assert gram.inference_table(spark, SIGNALS, months.span()).where("std_error IS NOT NULL").count() == 0
    twins = gram.monthly_statistics(table.withColumn("b", F.col("a") * 2), ["a", "b"]).span()
    assert gram.accuracy(twins, gram.fit(twins))[1] == pytest.approx(gram.accuracy(twins, gram.Linear(*one_signal(table)))[1])
    empty = gram.monthly_statistics(odd.limit(0), SIGNALS)
    assert gram.fit(empty.span()) == gram.Linear(0.0, (0.0,) * 3) and gram.accuracy(empty.span(), model) == (0, None, None)
    assert empty.expanding() == []


def one_signal(table):
    model = gram.fit(gram.monthly_statistics(table, ["a"]).span())
    return model.intercept, (*model.slopes, 0.0)


def test_large_means_lose_no_digits(table):
    moved = gram.monthly_statistics(table.withColumn("b", F.col("b") + 1e9), SIGNALS).span()
    assert gram.fit(moved).slopes == pytest.approx(gram.fit(gram.monthly_statistics(table, SIGNALS).span()).slopes, rel=1e-5)


def test_category_index_and_indicator(spark):
    df = spark.createDataFrame([(x,) for x in "bbaacd"], "industry string")
    got = models.encode_category(df, "industry", "i", "v").select("industry", "i", vector_to_array("v").alias("v")).distinct()
    assert {r["industry"]: (r["i"], r["v"]) for r in got.collect()} == {
        "a": (0.0, [1.0, 0.0, 0.0]), "b": (1.0, [0.0, 1.0, 0.0]), "c": (2.0, [0.0, 0.0, 1.0]), "d": (3.0, [0.0, 0.0, 0.0]),
    }
    one = models.encode_category(spark.createDataFrame([("x",), ("x",)], "industry string"), "industry", "i", "v")
    assert [(r["i"], r["v"].size) for r in one.collect()] == [(0.0, 0)] * 2


def test_bins_hold_equal_counts_of_whole_values(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)), 5.0, None if i % 3 else rng.random(), math.nan if i % 2 else rng.random()) for i in range(6400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    found = {(r["signal"], r["bin"]): (r["low"], r["rows"]) for r in binning.bin_counts(df.repartition(11), list("abcde")).collect()}
    for k, name in enumerate("abcde"):
        values = sorted(r[k] for r in rows if r[k] is not None and not math.isnan(r[k]))
        want = {}
        for x in values:
            want.setdefault(bisect.bisect_left(values, x) * 32 // len(values), []).append(x)
        assert {b: v for (s, b), v in found.items() if s == name} == {b: (xs[0], len(xs)) for b, xs in want.items()}
    bins = binning.fit_bins(df, list("abcde"))
    assert len(bins.limits["a"]) == 31 and len(bins.limits["b"]) == 3 and bins.limits["c"] == ()
    vector = bins.features(df).select(vector_to_array("features").alias("v"), "a", "d").collect()
    for r in vector:
        assert r["v"][0] == bisect.bisect_right(bins.limits["a"], r["a"])
        assert r["d"] is not None or r["v"][3] == len(bins.limits["d"]) + 1


def test_a_rare_value_between_frequent_ones_joins_the_bin_below(spark):
    df = spark.range(100_000).selectExpr("CASE WHEN id < 52900 THEN 0D WHEN id < 53500 THEN 1D ELSE 2D END AS a", "IF(id < 3, 0D, 1D) AS b")
    assert binning.fit_bins(df, ["a", "b"]).limits == {"a": (2.0,), "b": ()}
    assert binning.fit_bins(df.limit(0), ["a"]).limits == {"a": ()}


@pytest.mark.parametrize("kind", ["dt", "gbt"])
def test_binned_trees_do_not_depend_on_partitions(spark, kind):
    rows = spark.range(30_000).selectExpr("id AS permno", "sin(id) AS a", "cos(id * 3) AS b", "sin(id) * 2 + cos(id * id) AS ret")
    found = []
    for partitions in (4, 16, 64):
        dealt = rows.repartition(partitions, "permno")
        train = binning.fit_bins(dealt, ["a", "b"]).features(dealt)
        model = models.tree(kind, **({"maxDepth": 4} if kind == "dt" else {"maxIter": 2, "maxDepth": 3})).fit(train)
        found.append(re.findall(r"[<>]=? ?-?[\d.]+|feature \d+", model.toDebugString))
    assert found[0] and found[0] == found[1] == found[2]
