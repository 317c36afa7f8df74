"""A panel kept on files for re-use: one folder per year, clustered by security within it.

The store is an external table: partitions by year, so that a restated year replaces that year's files and no others, and
buckets by security, so that windows over a security's history need no shuffle. A later session opens it again by its path.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def open_panel(
    spark: SparkSession, table: str, path: str, like: DataFrame, buckets: int = 64, key: str = "permno", order: str = "date"
) -> DataFrame:
    """The panel at ``path`` under the name ``table``, with the columns of ``like`` (a ``year`` among them).

    An empty folder is an empty panel. ``buckets`` must be that of the first time.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema if f.name != "year")
    year = like.schema["year"].dataType.simpleString()
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{table}` ({columns}, year {year}) USING parquet PARTITIONED BY (year) "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`, `{order}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"ALTER TABLE `{table}` RECOVER PARTITIONS")
    return spark.table(table)


@contextmanager
def _only_given_years(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(OVERWRITE, "static")
    spark.conf.set(OVERWRITE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE, before)


def replace_years(spark: SparkSession, table: str, rows: DataFrame, buckets: int = 64, key: str = "permno") -> None:
    """Write ``rows``; the years they hold are replaced whole, all others stay as they are.

    Rows are dealt as the buckets are, so each task writes one file per year. Rows without a year or security are set aside.
    """
    columns = [c for c in spark.table(table).columns if c != "year"]
    whole = rows.where(F.col("year").isNotNull() & F.col(key).isNotNull()).select(*columns, "year")
    with _only_given_years(spark):
        whole.repartition(buckets, key).write.mode("overwrite").insertInto(table)
    spark.catalog.refreshTable(table)
