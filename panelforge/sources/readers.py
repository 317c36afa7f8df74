"""Files in, files out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType, StructType

from panelforge.storage import durable


def whole_number(text: Column, kind: DataType) -> Column:
    """Text as an integer, by way of an exact decimal: ``10``, ``10.0`` and `` 10 `` are 10; a fraction or other text NULL."""
    exact = F.trim(text.cast("string")).try_cast("decimal(38,10)")
    return F.when(exact == F.floor(exact), exact).try_cast(kind)


def _values(raw: DataFrame, schema: StructType) -> list[Column]:
    textual = {f.name.lower() for f in raw.schema if isinstance(f.dataType, StringType)}
    return [
        whole_number(F.col(f"`{f.name}`"), f.dataType)
        if f.name.lower() in textual and isinstance(f.dataType, IntegralType)
        else F.col(f"`{f.name}`").try_cast(f.dataType)
        for f in schema.fields
    ]


def typed(raw: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` by name, each in its type; what does not fit becomes NULL (``ingest`` counts it)."""
    return raw.select(*[c.alias(f.name) for c, f in zip(_values(raw, schema), schema.fields)])


def read_raw(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A CSV (with header), Parquet or ORC path as it is; CSV columns are text.

    Every file of a CSV folder must have the header of the first: the header is checked in each file when it
    is read, and another order or another name fails, so that no value lands under a wrong name.
    """
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    reader = spark.read.option("header", True)
    return reader.option("enforceSchema", False).schema(reader.csv(path).schema).csv(path)


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """Columns of ``schema`` by name from a CSV (with header), Parquet or ORC path.

    CSV is read as text and cast, so no pass over the file is spent on inference, extra columns
    are pruned at the scan and a malformed number becomes NULL instead of a failure.
    """
    return typed(read_raw(spark, path, fmt), schema)


def ingest(raw: DataFrame, schema: StructType, label: str, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The typed table, stored, and ``column, rows, nulls, rejected`` per column, measured by the pass that stores it.

    A value is rejected if it is not blank and does not fit its type. ``keys`` must be present: for them a blank or missing value is
    rejected too, as such rows are set aside. The file is read once, however often the stored table is. Runs a job.
    """
    both = raw.select(
        *[F.col(f"`{f.name}`").alias(f"raw_{i}") for i, f in enumerate(schema.fields)],
        *[c.alias(f"typed_{i}") for i, c in enumerate(_values(raw, schema))],
    )
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(schema.fieldNames()):
        missing = F.col(f"typed_{i}").isNull()
        given = F.lit(True) if name in keys else F.trim(F.coalesce(F.col(f"raw_{i}").cast("string"), F.lit(""))) != ""
        measures += [F.count_if(missing).alias(f"nulls_{i}"), F.count_if(given & missing).alias(f"rejected_{i}")]
    seen = Observation()
    observed = both.observe(seen, *measures)
    stored = durable(observed.select(*[F.col(f"typed_{i}").alias(f.name) for i, f in enumerate(schema.fields)]), label)
    found = seen.get
    rows = [(f.name, found["rows"], found[f"nulls_{i}"], found[f"rejected_{i}"]) for i, f in enumerate(schema.fields)]
    return stored, raw.sparkSession.createDataFrame(rows, "column string, rows long, nulls long, rejected long")


def write_result(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "error"
) -> None:
    """Write a result where it is computed; nothing passes through the driver."""
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def load_factors(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Monthly factor returns as fractions: ``date, year, month, mkt_rf, rf, mkt``.

    Monthly lines are recognised by their six-digit date, so the annual block and the notes that
    follow in the file drop out wherever they stand.
    """
    stamp = F.trim(F.col("Date").cast("string"))
    monthly = raw.where(stamp.rlike("^[0-9]{6}$")).select(
        F.try_to_date(F.concat(stamp, F.lit("01")), "yyyyMMdd").alias("date"),
        (F.col("`Mkt-RF`").try_cast("double") * 0.01).alias("mkt_rf"),
        (F.col("RF").try_cast("double") * 0.01).alias("rf"),
    )
    return monthly.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        "mkt_rf",
        "rf",
        (F.col("mkt_rf") + F.col("rf")).alias("mkt"),
    )


def with_date(df: DataFrame, column: str, fmt: str) -> DataFrame:
    """A text date column as a date; bad text becomes NULL."""
    return df.withColumn(column, F.try_to_date(F.col(column).cast("string"), fmt))
