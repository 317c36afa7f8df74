import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("panelforge-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def months(spark):
    """A security's history from its returns: one row per month-end from January 2000 on."""

    def build(returns, permno=1, **columns):
        names = list(columns)
        rows = [(permno, i, r, *(columns[c][i] for c in names)) for i, r in enumerate(returns)]
        types = "".join(f", {c} double" for c in names)
        df = spark.createDataFrame(rows, f"permno long, i int, ret double{types}")
        return df.selectExpr("permno", "last_day(add_months(date'2000-01-01', i)) AS date", "ret", *names)

    return build


def column(df, name, *order):
    """Values of one column in order."""
    return [r[0] for r in df.orderBy(*(order or ("date",))).select(name).collect()]
