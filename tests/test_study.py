"""The whole study from CSV files, against the registered queries over the same tables."""

import pytest
from pyspark.sql import functions as F

from checks.study import SAMPLE, Study
from panelforge.operators import portfolios
from panelforge.plans import study
from panelforge.settings import MACRO_SERIES
from panelforge.sources import readers
from panelforge.sources import star_schema as star

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The derived inputs as the CSV files a user would have."""
    folder = tmp_path_factory.mktemp("files")
    source = Study(spark, FOLDER)

    def slashed(df, column):
        return df.withColumn(column, F.date_format(column, study.DATE_FORMAT))

    tables = {
        "months": slashed(source.raw, "date"),
        "factors": star.factor_file(source.table("orders")),
        "accounts": slashed(source.accounts, "datadate"),
        "links": source.links,
        "macro": spark.createDataFrame(
            [(f"{y}-{m:02d}-{d:02d}", y + m + d / 100) for y in range(1995, 2002) for m in (1, 7) for d in (5, 20)],
            "date string, GS1 double",
        ).selectExpr("date", *[f"{'GS1' if n == 'GS1' else 'CAST(NULL AS double)'} AS {n}" for n in MACRO_SERIES]),
        "extra": slashed(star.fundamental_extra(source.accounts), "datadate"),
    }
    for name, df in tables.items():
        readers.write_result(df, f"{folder}/{name}", fmt="csv")
    return {name: f"{folder}/{name}" for name in tables}


@pytest.fixture(scope="module")
def results(spark, files):
    return study.full_study(study.read_inputs(spark, files, SAMPLE), SAMPLE)


def test_benchmark_returns_equal_the_registered_pipeline(spark, results):
    want = Study(spark, FOLDER).portfolios("size").selectExpr("grp", "year", "month", "round(value_ret, 9) AS r")
    got = results["benchmark_returns"].where("signal = 'size'").selectExpr("grp", "year", "month", "round(value_ret, 9) AS r")
    assert got.count() == want.count() > 700
    assert got.exceptAll(want).count() == 0


def test_every_result_has_rows_and_is_written(spark, results, tmp_path):
    study.write_study(results, str(tmp_path))
    for name, table in results.items():
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert back.columns == table.columns and back.count() > 0, name


def test_panel_carries_macro_extra_and_industry(spark, files):
    research = study.build_research(study.read_inputs(spark, files, SAMPLE), SAMPLE)
    march = research.where("year = 1999 AND month = 3").select("GS1").distinct().collect()
    assert [r["GS1"] for r in march] == [1999 + 1 + 0.20]
    assert research.where("prba IS NOT NULL").count() > 0
    want = {(r["industry"], r["industry_index"]) for r in Study(spark, FOLDER).indexed.select("industry", "industry_index").distinct().collect()}
    assert {i for i, _ in want} == {r["industry"] for r in research.select("industry", "industry_index").distinct().collect()}


def test_rejects_and_beta_portfolios(spark, results):
    counts = {(r["file"], r["column"]): r["rejected"] for r in results["rejects"].collect()}
    assert counts["months", "permno"] == counts["accounts", "gvkey"] == 0 and len({f for f, _ in counts}) == 5
    want = Study(spark, FOLDER).portfolios("beta_lag").selectExpr("grp", "year", "month", "round(equal_ret, 9) AS r")
    got = results["beta_returns"].selectExpr("grp", "year", "month", "round(equal_ret, 9) AS r")
    assert got.count() == want.count() > 700 and got.exceptAll(want).count() == 0
    assert {r["period"] for r in results["beta_terminal"].collect()} == {"train", "validation", "out"}


def test_each_input_file_is_read_once(spark, files, tmp_path):
    inputs = study.read_inputs(spark, files, SAMPLE)
    for name in ("months", "accounts", "links"):
        assert "Scan csv" not in inputs[name]._jdf.queryExecution().executedPlan().toString(), name
    panel = study.store_panel(inputs, SAMPLE, f"{tmp_path}/panel", "study_panel", 4)
    assert panel.count() == Study(spark, FOLDER).panel.count()
    assert len(list(tmp_path.glob("panel/year=1999/*.parquet"))) <= 4
    spark.sql("DROP TABLE study_panel")


def test_models_cover_all_samples(results):
    accuracy = {(r["model"], r["sample"]) for r in results["tree_accuracy"].collect()}
    assert accuracy == {(m, s) for m in ("dt", "rf", "gbt") for s in ("validation", "out", "recent")} | {
        ("dt_core", "validation"), ("gbt_core", "validation"),
    }
    tested = {(r["model"], r["sample"]) for r in results["model_wealth"].select("model", "sample").distinct().collect()}
    assert tested == {(m, s) for m in ("ols", "rf", "gbt") for s in ("validation", "out", "recent")}
    assert {r["model"] for r in results["coefficients"].collect()} == {"ols", "ridge", "glm"}


def test_strategies_are_out_of_sample(results):
    months = results["strategy_returns"].agg(F.min(portfolios.month_end()), F.max(portfolios.month_end())).first()
    assert [str(m) for m in months] == ["2000-07-31", "2001-11-30"]
    assert {r["strategy"] for r in results["strategy_performance"].collect()} == set(study.LEGS)
