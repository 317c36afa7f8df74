"""A security panel derived from an order-line star schema.

The supplier plays the security, the ship month the period and the ship year the fiscal year.
Arithmetic on the keys plants what real files contain: sentinel returns, negative prices, foreign
share codes, missing items, open and expired links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from panelforge.functions.numeric import ratio
from panelforge.functions.rolling import history


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _unless(key: Column, divisor: int, value: Column) -> Column:
    return F.when(key % divisor != 0, value)


def _money(column: str) -> Column:
    """Exact sum of money in whole cents, so that no result depends on the order of addition."""
    return F.sum(F.rint(F.col(column) * 100).cast("bigint")) / 100


def trade_months(lineitem: DataFrame) -> DataFrame:
    """Average price and volume per security and month-end.

    Grouping on both keys combines a heavy supplier's lines before the shuffle; what leaves is one
    row per security and month.
    """
    return (
        lineitem.groupBy(
            F.col("l_suppkey").alias("permno"), F.last_day(F.col("l_shipdate").cast("date")).alias("date")
        )
        .agg(_money("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("vol"))
        .select("permno", "date", ratio("amount", "vol").alias("prc"), "vol")
    )


def security_months(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Raw monthly security file."""
    key = F.col("permno")
    clock = key * 7 + F.year("date") * 12 + F.month("date")
    change = ratio("prc", F.lag("prc").over(history())) - 1
    shares = supplier.select(F.col("s_suppkey").alias("permno"), (F.col("s_acctbal") + 2000).alias("shrout"))
    return (
        trade_months(lineitem)
        .join(shares, "permno")
        .select(
            "permno",
            (key - key % 2).alias("permco"),
            "date",
            F.when(key % 11 == 0, 12).otherwise(10 + key % 2).cast("int").alias("shrcd"),
            (1 + key % 4).cast("int").alias("exchcd"),
            _unless(key, 13, 100 + (key * 97) % 9900).cast("int").alias("siccd"),
            F.when((key + F.month("date")) % 5 == 0, -F.col("prc")).otherwise(F.col("prc")).alias("prc"),
            F.when(clock % 41 == 0, "B")
            .when(clock % 43 == 0, "-99")
            .otherwise(change.cast("decimal(18,6)").cast("string"))
            .alias("ret"),
            "vol",
            "shrout",
        )
    )


def factor_file(orders: DataFrame) -> DataFrame:
    """Monthly factor file in percent; one row per calendar month."""
    monthly = orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        _money("o_totalprice").alias("amount"), F.count("o_totalprice").alias("n")
    )
    return monthly.select(
        (F.col("year") * 100 + F.col("month")).cast("string").alias("Date"),
        ((F.col("amount") / F.col("n") / 150000 - 1) * 10).alias("Mkt-RF"),
        (0.2 + 0.01 * F.col("month")).alias("RF"),
    )


def fundamentals(lineitem: DataFrame) -> DataFrame:
    """Annual accounts per company, one row per supplier and ship year."""
    key = F.col("gvkey")
    yearly = lineitem.groupBy(F.col("l_suppkey").alias("gvkey"), F.year("l_shipdate").alias("fyear")).agg(
        F.sum("l_extendedprice").alias("sales"),
        F.sum("l_quantity").alias("units"),
        F.sum("l_tax").alias("tax"),
        F.sum("l_discount").alias("discount"),
        F.sum(F.col("l_tax") * F.col("l_extendedprice")).alias("tax_due"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revt"),
        F.sum(F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("ni"),
    )
    return yearly.select(
        "gvkey",
        "fyear",
        F.make_date("fyear", F.lit(12), F.lit(31)).alias("datadate"),
        F.when(key % 17 == 0, "SUMM_STD").otherwise("STD").alias("datafmt"),
        F.col("sales").alias("at"),
        (F.col("sales") * 0.55).alias("lt"),
        _unless(key, 3, F.col("sales") * 0.45).alias("seq"),
        _unless(key, 6, F.col("sales") * 0.40).alias("ceq"),
        F.col("units").alias("pstk"),
        _unless(key, 4, F.col("units") * 2).alias("pstkrv"),
        _unless(key, 8, F.col("units") * 3).alias("pstkl"),
        _unless(key, 5, F.col("tax_due")).alias("txditc"),
        _unless(key, 10, F.col("tax")).alias("itcb"),
        (F.col("tax") * 2).alias("txdb"),
        "revt",
        "ni",
        (F.col("units") * 10).alias("act"),
        F.when(key % 9 == 0, 0.0).otherwise(F.col("units") * 4).alias("lct"),
        F.col("discount").alias("xrd"),
    )


def links(supplier: DataFrame) -> DataFrame:
    """Three dated links per company: an expired one, an open one and one of a type to reject."""
    key = F.col("s_suppkey")
    rows = [("LU", "P", "19950101", "19981231"), ("LC", "C", "19990101", "E"), ("NR", "N", "19950101", "E")]
    names = ("linktype", "linkprim", "linkdt", "linkenddt")
    link = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]))
    return supplier.select(
        key.alias("gvkey"), key.alias("lpermno"), (key - key % 2).alias("lpermco"), link.alias("link")
    ).select("gvkey", "lpermno", "lpermco", "link.*")


def fundamental_extra(accounts: DataFrame) -> DataFrame:
    """An extra annual item; companies whose accounts are not in the standard format get none that counts."""
    key = F.col("gvkey")
    return accounts.select(
        "gvkey",
        "datadate",
        F.when(key % 7 == 0, "SUMM_STD").otherwise("STD").alias("datafmt"),
        (F.col("lct") * 0.1).alias("prba"),
    )


CODED = StructType([StructField("permno", LongType()), StructField("shrcd", IntegerType()), StructField("prc", DoubleType())])


def coded_file(lineitem: DataFrame) -> DataFrame:
    """A file as text, one row per order line: whole numbers with and without a decimal point, blanks around
    and for them, fractions, letters."""
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    code = (
        F.when((key + n) % 7 == 0, F.concat(key.cast("string"), F.lit(".0")))
        .when((key + n) % 7 == 1, F.concat(F.lit(" "), key.cast("string"), F.lit(" ")))
        .when((key + n) % 7 == 2, F.concat(key.cast("string"), F.lit(".5")))
        .when((key + n) % 7 == 3, F.concat(F.lit("Z"), key.cast("string")))
        .when((key + n) % 7 == 4, F.lit(" "))
        .otherwise(key.cast("string"))
    )
    share = F.when(n % 3 == 0, F.lit("10.0")).when(n % 3 == 1, F.lit("11"))
    price = F.when(n % 4 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    return lineitem.select(key.alias("line_key"), n.alias("line"), code.alias("permno"), share.alias("shrcd"), price.alias("prc"))


def macro_daily(orders: DataFrame) -> DataFrame:
    """Daily macro file ``series, date, value``, with days that have no value."""
    daily = orders.groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("date"))
    known = daily.agg(_money("o_totalprice").alias("amount"))
    return known.select("series", "date", F.when(F.dayofmonth("date") % 7 != 0, F.col("amount")).alias("value"))


def macro_file(orders: DataFrame) -> DataFrame:
    """Long macro file ``series, year, month, value``: one monthly series, the others quarterly."""
    return (
        orders.groupBy(
            F.col("o_orderpriority").alias("series"),
            F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("month"),
        )
        .agg(_money("o_totalprice").alias("amount"), F.count("o_totalprice").alias("n"))
        .where(F.col("series").startswith("1") | F.col("month").isin(3, 6, 9, 12))
        .select("series", "year", "month", (F.col("amount") / F.col("n")).alias("value"))
    )
