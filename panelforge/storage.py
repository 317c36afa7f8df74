"""Tables that outlive executors: written to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_default: list[str] = []

#: Setting of Spark: a finished query's shuffle files are removed at once, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def use_folder(path: str) -> None:
    """The shared folder of sessions that do not set ``spark.checkpoint.dir`` (tests, a single machine)."""
    _default[:] = [path]


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the one given to ``use_folder``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or next(iter(_default), None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/panelforge/{spark.sparkContext.applicationId}/{label}-{uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, object]) -> Iterator[None]:
    """Queries planned inside have these settings; what was set before is put back."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind: what follows reads the tables."""
    with settings(spark, {CLEANUP: "true"}):
        yield


def durable(df: DataFrame, label: str, sort: Sequence[str] = (), **options) -> DataFrame:
    """Write ``df`` once and continue from the files. Runs a job when called; ``options`` are those of the writer.

    Three uses: a table that several branches read is computed once; lineage is cut; and Catalyst
    sees the true size of a small aggregate, so it broadcasts it only when it fits
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise. ``sort`` orders the rows of each
    file, so that later filters on those columns skip the pages that cannot match.
    """
    if sort:
        df = df.sortWithinPartitions(*sort)
    path = new_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def clustered(df: DataFrame, label: str, key: str, buckets: int) -> Iterator[DataFrame]:
    """``df`` stored in ``buckets`` by ``key``, as long as the block lasts: however often it is grouped by ``key``, it is shuffled once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    name = f"clustered_{path[-32:]}"
    with shuffles_removed(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name, format="parquet")
    try:
        yield (table := spark.table(name))
        release(table)
    finally:
        spark.sql(f"DROP TABLE {name}")


def release(*tables: DataFrame) -> None:
    """Remove the files of tables as ``durable`` returned them, when nothing reads them any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def drop_stored(spark: SparkSession) -> None:
    """Remove every table this application stored, when nothing reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/panelforge/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
