import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.operators import fundamentals, linking, macro
from tests.conftest import column

ITEMS = "seq ceq pstk at lt txditc itcb txdb pstkrv pstkl".split()


def accounts(spark, **given):
    schema = "gvkey long, lpermno long, datadate date, " + ", ".join(f"{i} double" for i in ITEMS)
    row = (1, 1, dt.date(2000, 12, 31), *(given.get(i) for i in ITEMS))
    return spark.createDataFrame([row], schema)


def book(spark, **given):
    r = fundamentals.book_equity(accounts(spark, **given)).first()
    return r["she"], r["dt"], r["ps"], r["be"]


def test_book_equity_fallbacks(spark):
    base = dict(pstkrv=1.0, txditc=2.0)
    assert book(spark, seq=10.0, **base) == (10.0, 2.0, 1.0, 11.0)
    assert book(spark, ceq=6.0, pstk=3.0, at=50.0, lt=1.0, **base)[0] == 9.0
    assert book(spark, ceq=6.0, at=50.0, lt=1.0, **base)[0] == 49.0
    assert book(spark, seq=1.0, itcb=3.0, txdb=4.0)[1] == 7.0
    assert book(spark, seq=1.0, itcb=3.0)[1] == 3.0
    assert book(spark, seq=1.0, txdb=4.0)[1] == 4.0
    assert book(spark, seq=1.0, pstkl=5.0, pstk=6.0)[2] == 5.0
    assert book(spark, seq=1.0, pstk=6.0)[2] == 6.0


def test_book_equity_needs_all_three_parts(spark):
    assert book(spark, seq=10.0, pstk=1.0)[3] is None
    assert book(spark, seq=10.0, txditc=1.0)[3] is None
    assert book(spark, pstk=1.0, txditc=1.0)[3] is None


LINKS = "gvkey long, linktype string, linkprim string, lpermno long, lpermco long, linkdt int, linkenddt string"


def test_links_are_filtered_and_dated(spark):
    links = spark.createDataFrame(
        [
            (1, "LU", "P", 10, 100, 19990101, "20001231"),
            (1, "LC", "C", 11, 100, 20010101, "E"),
            (1, "NR", "P", 12, 100, 19990101, "E"),
            (1, "LU", "N", 13, 100, 19990101, "E"),
        ],
        LINKS,
    )
    comp = spark.createDataFrame(
        [(1, d, f) for d in ("1998-12-31", "1999-01-01", "2000-12-31", "2001-06-30", "2002-06-30") for f in ("STD", "SUMM")],
        "gvkey long, d string, datafmt string",
    ).select("gvkey", F.to_date("d").alias("datadate"), "datafmt")
    got = linking.link_fundamentals(comp, links, "2001-12-31").select("datadate", "lpermno").collect()
    assert {(str(d), p) for d, p in got} == {("1999-01-01", 10), ("2000-12-31", 10), ("2001-06-30", 11)}


def test_growth_and_lags_per_company(spark):
    rows = [(1, y, v) for y, v in ((2000, 10.0), (2001, 15.0), (2002, 0.0), (2003, 5.0))] + [(2, 2000, 1.0)]
    df = spark.createDataFrame(rows, "gvkey long, y int, xrd double").selectExpr(
        "gvkey", "gvkey AS lpermno", "make_date(y, 12, 31) AS datadate", "xrd"
    )
    df = fundamentals.growth_lags(fundamentals.growth(df, ["xrd"]))
    one = df.where("gvkey = 1")
    assert column(one, "xrd_growth", "datadate") == [None, 0.5, -1.0, None]
    assert column(one, "xrd_growth_lag1", "datadate") == [None, None, 0.5, -1.0]
    assert column(one, "xrd_growth_lag2", "datadate") == [None, None, None, 0.5]


def test_ratios_are_missing_on_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 2.0, 4.0, 0.0)], "act double, lct double, size double, be double, ni double, prc_lag double")
    df = df.withColumn("revt", F.lit(3.0))
    row = fundamentals.price_ratios(fundamentals.value_factor(fundamentals.current_ratio(df))).first()
    assert (row["current_ratio"], row["value"], row["ep"], row["sp"]) == (None, None, None, None)


@pytest.fixture
def shared_company(spark):
    panel = spark.createDataFrame([(1, 100, 2000), (2, 100, 2000), (3, 300, 2000)], "permno long, permco long, fyear int")
    comp = spark.createDataFrame(
        [(7, 1, 100, 2000, "2000-06-30", 1.0), (8, 2, 100, 2000, "2000-12-31", 2.0), (6, 2, 100, 2000, "2000-12-31", 3.0)],
        "gvkey long, lpermno long, lpermco long, fyear int, d string, be double",
    ).withColumn("datadate", F.to_date("d")).drop("d")
    return panel, comp


def test_shared_company_fans_out(shared_company):
    got = linking.join_fundamentals(*shared_company).select("permno", "gvkey").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(p, g) for p in (1, 2) for g in (6, 7, 8)] + [(3, None)], key=str
    )


def test_dedupe_takes_latest_date_then_lowest_company(shared_company):
    got = linking.join_fundamentals(*shared_company, dedupe=True).select("permno", "gvkey", "be").collect()
    assert sorted(map(tuple, got)) == [(1, 6, 3.0), (2, 6, 3.0), (3, None, None)]


def test_extra_item_ignores_other_formats(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1)], "gvkey long, datadate int")
    extra = spark.createDataFrame([(1, 1, "STD", 5.0), (2, 1, "SUMM", 6.0)], "gvkey long, datadate int, datafmt string, prba double")
    got = linking.join_fundamental_extra(comp, extra).select("gvkey", "prba").collect()
    assert sorted(map(tuple, got)) == [(1, 5.0), (2, None)]


def test_macro_values_are_carried_forward(spark):
    long = spark.createDataFrame(
        [("GDP", 2000, 1, 1.0), ("GDP", 2000, 4, 4.0), ("GS1", 2000, 2, 0.2), ("GS1", 2000, 3, None)],
        "series string, year int, month int, value double",
    )
    panel = spark.createDataFrame([(1999, 12), (2000, 1), (2000, 3), (2000, 4), (2000, 6)], "year int, month int")
    got = macro.join_macro(panel, long, "2000-06-30", ["GDP", "GS1", "GS10"]).collect()
    assert {(r["year"], r["month"]): (r["GDP"], r["GS1"], r["GS10"]) for r in got} == {
        (1999, 12): (None, None, None),
        (2000, 1): (1.0, None, None),
        (2000, 3): (1.0, 0.2, None),
        (2000, 4): (4.0, 0.2, None),
        (2000, 6): (4.0, 0.2, None),
    }


def test_wide_macro_file_becomes_long(spark):
    wide = spark.createDataFrame([("2000-01-31", 1.0, 2.0)], "d string, GDP double, GS1 double").select(
        F.to_date("d").alias("date"), "GDP", "GS1"
    )
    got = macro.macro_long(wide, ["GDP", "GS1"]).collect()
    assert sorted((r["series"], str(r["date"]), r["value"]) for r in got) == [("GDP", "2000-01-31", 1.0), ("GS1", "2000-01-31", 2.0)]


@pytest.mark.parametrize("order", ["date", "date DESC", "value % 7, date"])
def test_daily_series_count_by_their_last_day(spark, order):
    daily = spark.range(60).selectExpr("'GS1' AS series", "date_add(date'2000-01-01', cast(id AS int)) AS date", "id + 0.0D AS value")
    daily = daily.unionByName(spark.sql("SELECT 'GS1' AS series, date'2000-01-31' AS date, CAST(NULL AS double) AS value"))
    panel = spark.createDataFrame([(2000, m) for m in range(1, 5)], "year int, month int")
    daily.createOrReplaceTempView("daily_series")
    shuffled = spark.sql(f"SELECT * FROM daily_series ORDER BY {order}")
    got = macro.join_macro(panel, shuffled, "2000-04-30", ["GS1"]).collect()
    assert {r["month"]: r["GS1"] for r in got} == {1: 30.0, 2: 59.0, 3: 59.0, 4: 59.0}


def test_two_links_over_one_date_give_the_same_rows_under_any_layout(spark):
    accounts = spark.createDataFrame(
        [(1, y, f"{y}-12-31", "STD", 100.0 + y, 1.0) for y in (1998, 1999, 2000)],
        "gvkey long, fyear int, datadate string, datafmt string, at double, revt double",
    ).withColumn("datadate", F.to_date("datadate"))
    links = spark.createDataFrame(
        [(1, 7, 6, "LU", "P", "19900101", "20001231"), (1, 7, 6, "LC", "C", "19991231", "E")],
        "gvkey long, lpermno long, lpermco long, linktype string, linkprim string, linkdt string, linkenddt string",
    )
    linked = linking.link_fundamentals(accounts, links, "2002-01-01")

    def rows(df):
        grown = fundamentals.growth(df, ["at", "revt"])
        return sorted(map(str, grown.collect())), sorted(map(str, linking.latest_per_key(df, ["lpermco", "fyear"]).collect()))

    first = rows(linked)
    assert len(first[0]) == 5
    assert all(rows(linked.repartition(n, "linktype").sortWithinPartitions(F.desc("linktype"))) == first for n in (1, 3, 7))
