import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge import storage
from panelforge.operators import cleaning, profiling
from panelforge.sources import panel_store, readers, schemas
from panelforge.sources import star_schema as star


def test_csv_is_read_by_name_with_given_types(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "date,PERMNO,extra,RET,PRC,SHRCD,EXCHCD,SICCD,VOL,SHROUT,PERMCO\n"
        "1998/07/31,10,x,B,-5.5,10,1,Z,,3,20\n1998/08/31,10,x,0.5,oops,11,2,2000,7,3,20\n"
    )
    df = readers.read_table(spark, f"{tmp_path}/m.csv", schemas.SECURITY_MONTH)
    assert df.columns == schemas.SECURITY_MONTH.fieldNames()
    assert [f.dataType for f in df.schema] == [f.dataType for f in schemas.SECURITY_MONTH]
    rows = df.orderBy("date").collect()
    assert rows[0]["prc"] == -5.5 and rows[0]["vol"] is None and rows[0]["ret"] == "B"
    assert rows[1]["prc"] is None and rows[1]["permno"] == 10
    clean = cleaning.with_calendar(cleaning.clean_price(cleaning.clean_returns(df)), fmt="yyyy/MM/dd")
    first = clean.orderBy("date").first()
    assert (first["date"], first["prc"], first["ret"], first["siccd"]) == (dt.date(1998, 7, 31), 5.5, None, None)


def test_csv_scan_reads_only_the_columns_asked_for(spark, tmp_path):
    (tmp_path / "l.csv").write_text("gvkey,linktype,linkprim,lpermno,lpermco,linkdt,linkenddt,conm\n1,LU,P,2,3,19990101,E,Firm\n")
    df = readers.read_table(spark, f"{tmp_path}/l.csv", schemas.LINK).select("gvkey", "linkenddt")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<gvkey:string,linkenddt:string>" in plan
    assert tuple(df.first()) == (1, "E")


def test_factor_file_keeps_monthly_lines_only(spark, tmp_path):
    (tmp_path / "f.csv").write_text(
        "Date,Mkt-RF,SMB,RF\n195702, 9,1,0.1\n195703, 2.13,1,0.23\n201612,1.82,1,0.03\n201701,1,1,1\n"
        " Annual Factors: January-December,,,\n1957,-13,1,3\n"
    )
    raw = readers.read_table(spark, f"{tmp_path}/f.csv", schemas.FACTOR_MONTH)
    rows = readers.load_factors(raw, "1957-03-01", "2016-12-31").orderBy("date").collect()
    assert [(r["year"], r["month"]) for r in rows] == [(1957, 3), (2016, 12)]
    assert rows[0]["mkt_rf"] == pytest.approx(0.0213) and rows[0]["mkt"] == pytest.approx(0.0236)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv"])
def test_written_result_reads_back(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "LU", 1999), (2, "LC", 2000)], "gvkey long, linktype string, year int")
    readers.write_result(df, f"{tmp_path}/out", ["year"], fmt)
    schema = df.schema
    back = readers.read_table(spark, f"{tmp_path}/out", schema, fmt)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_lookup_by_list_is_pushed_to_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS permno", "id * 2.0D AS ret").write.parquet(f"{tmp_path}/p")
    df = profiling.securities(spark.read.parquet(f"{tmp_path}/p"), [3, 5], ["permno", "ret"])
    assert sorted(r["ret"] for r in df.collect()) == [6.0, 10.0]
    assert "In(permno, [3,5])" in df._jdf.queryExecution().executedPlan().toString()


def test_durable_uses_the_shared_folder(spark):
    df = storage.durable(spark.range(5), "five")
    assert df.count() == 5
    folder = spark.conf.get("spark.checkpoint.dir", None) or storage.shared_folder(spark)
    assert folder.removeprefix("file:") in df.inputFiles()[0]


class FakeSpark:
    def __init__(self, folder, master):
        self.conf = type("Conf", (), {"get": lambda _, key, default: folder})()
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()


def test_shared_folder_is_named_explicitly_or_refused(monkeypatch):
    monkeypatch.setattr(storage, "_default", [])
    assert storage.shared_folder(FakeSpark("s3://bucket/checkpoints", "yarn")) == "s3://bucket/checkpoints"
    for master in ("yarn", "local[2]"):
        with pytest.raises(RuntimeError):
            storage.shared_folder(FakeSpark(None, master))
    storage.use_folder("/shared")
    assert storage.shared_folder(FakeSpark(None, "yarn")) == "/shared"



def test_a_heavy_security_is_combined_before_the_shuffle(spark):
    lines = spark.range(20000).selectExpr(
        "if(id % 3 = 0, 7L, id) AS l_suppkey", "timestamp_ntz'1999-05-01 00:00:00' AS l_shipdate",
        "1.0D AS l_quantity", "2.5D AS l_extendedprice",
    )
    plan = star.trade_months(lines)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    heavy = star.trade_months(lines).where("permno = 7").first()
    assert heavy["vol"] == 6667 + 1 - (7 % 3 == 0) and heavy["prc"] == 2.5


def test_whole_numbers_with_a_point_are_kept(spark, tmp_path):
    (tmp_path / "w.csv").write_text("permno,shrcd,siccd\n10, 11,3714.0\n20,10.0,Z\n30,10.5,0\n,11,100\nx,11,100\n")
    schema = schemas.SECURITY_MONTH
    schema = type(schema)([f for f in schema if f.name in ("permno", "shrcd", "siccd")])
    raw = readers.read_raw(spark, f"{tmp_path}/w.csv")
    rows = [(r["permno"], r["shrcd"]) for r in readers.typed(raw, schema).collect()]
    assert rows == [(10, 11), (20, 10), (30, None), (None, 11), (None, 11)]
    stored, measured = readers.ingest(raw, schema, "w", ["permno"])
    assert sorted(map(str, stored.collect())) == sorted(map(str, readers.typed(raw, schema).collect()))
    counts = {r["column"]: (r["rows"], r["nulls"], r["rejected"]) for r in measured.collect()}
    assert counts == {"permno": (5, 2, 2), "shrcd": (5, 1, 1), "siccd": (5, 0, 0)}
    none = readers.ingest(raw.where("permno = 'none'"), schema, "none")[1].collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0)] * 3
    clean = cleaning.clean_returns(readers.typed(raw, schema).selectExpr("*", "'0.1' AS ret"))
    assert [r["siccd"] for r in clean.collect()] == [3714, None, 0, 100, 100]


def test_files_of_one_folder_must_have_one_header(spark, tmp_path):
    folder = tmp_path / "links"
    folder.mkdir()
    (folder / "a.csv").write_text("gvkey,linktype,lpermno\n1,LU,10\n")
    (folder / "b.csv").write_text("linktype,lpermno,gvkey\nLC,31,21\n")
    schema = type(schemas.LINK)([f for f in schemas.LINK if f.name in ("gvkey", "linktype", "lpermno")])
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_table(spark, str(folder), schema).collect()


def test_rows_without_id_or_date_share_no_window(spark):
    from panelforge.plans import panel

    rows = [(None, "1999-01-31", 1.0), (None, "1999-02-28", 2.0), (5, None, 3.0), (5, "1999-01-31", 4.0), (5, "1999-02-28", 5.0)]
    raw = spark.createDataFrame(rows, "permno long, date string, prc double").selectExpr(
        "permno", "cast(date AS date) AS date", "prc", "'0.1' AS ret", "'1' AS siccd", "1.0D AS shrout"
    )
    assert sorted((r["permno"], r["prc"], r["prc_lag"]) for r in panel.clean_months(raw).collect()) == [(5, 4.0, None), (5, 5.0, 4.0)]


def panel_rows(spark, years):
    return spark.range(3000).selectExpr(
        "id % 100 AS permno", "last_day(add_months(date'1990-01-01', int(id div 100))) AS date", "0.01D * (id % 7) AS ret", "id AS v"
    ).withColumn("year", F.year("date")).where(F.col("year").isin(years))


def test_a_restated_year_replaces_that_year_only(spark, tmp_path):
    from panelforge.operators import signals

    path, rows = f"{tmp_path}/panel", panel_rows(spark, [1990, 1991])
    panel_store.open_panel(spark, "store_a", path, rows, 4)
    assert spark.table("store_a").count() == 0
    panel_store.replace_years(spark, "store_a", rows, 4)
    files = lambda: {f.name: f.stat().st_mtime_ns for f in tmp_path.glob("panel/year=1990/*.parquet")}
    kept = files()
    assert 0 < len(kept) <= 4
    panel_store.replace_years(spark, "store_a", panel_rows(spark, [1991, 1992]).withColumn("v", -F.col("v")), 4)
    assert files() == kept
    found = {r["year"]: (r["n"], r["v"]) for r in spark.table("store_a").groupBy("year").agg(F.count("*").alias("n"), F.max("v").alias("v")).collect()}
    assert found == {1990: (1200, 1199), 1991: (1200, -1200), 1992: (600, -2400)}
    # Another session, or name, finds the same panel by its path.
    assert panel_store.open_panel(spark, "store_b", path, rows, 4).count() == 3000
    stored = signals.reversal(signals.momentum(spark.table("store_b")))
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
    plain = signals.reversal(signals.momentum(panel_rows(spark, [1990, 1991, 1992])))
    key = ["permno", "date", "momentum_12", "reversal"]
    assert stored.select(key).exceptAll(plain.select(key)).count() == 0
    for name in ("store_a", "store_b"):
        spark.sql(f"DROP TABLE {name}")


def test_rows_without_year_or_security_are_set_aside(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS permno, date'1990-01-31' AS date, 1 AS v, 1990 AS year UNION ALL SELECT NULL, NULL, 2, 1990 UNION ALL SELECT 3, NULL, 3, NULL")
    panel_store.open_panel(spark, "store_c", f"{tmp_path}/panel", rows, 2)
    panel_store.replace_years(spark, "store_c", rows, 2)
    assert [r["v"] for r in spark.table("store_c").collect()] == [1]
    spark.sql("DROP TABLE store_c")
