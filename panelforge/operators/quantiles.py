"""Exact quantile groups of a cross-section that need not fit one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.storage import durable


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _group_of(rank: Column, total: Column, n: int) -> Column:
    """Group 1..n of a rank from 0: the first (total mod n) groups hold one row more than the others."""
    short, longer = F.floor(total / n), total % n
    in_longer = longer * (short + 1)
    later = longer + F.floor((rank - in_longer) / F.greatest(short, F.lit(1)))
    return (F.when(rank < in_longer, F.floor(rank / (short + 1))).otherwise(later) + 1).cast("int")


def assign_quantile(
    df: DataFrame,
    signal: str,
    n: int = 10,
    by: Sequence[str] = ("date",),
    tie_break: Sequence[str] = ("permno",),
    out: str = "grp",
    drop_missing: bool = False,
) -> DataFrame:
    """Quantile group 1..n of ``signal`` within ``by``; the groups ``ntile`` would give. Stores ``df`` sorted.

    A missing signal sorts first, so it falls into the lowest groups unless ``drop_missing``.
    ``tie_break`` must make rows unique within a cross-section.

    The rows are sorted once, range-partitioned over cross-section *and* signal, so a large cross-section, a
    repeated value or a mass of missing signals spreads over many tasks. Row counts per task and cross-section
    give every task's first rank there; a row's rank is that plus its place, and its group follows by
    arithmetic. So the sorted rows are read once for the counts and once for the result, with one small join.
    Hand in the columns the result needs and no others.
    """
    by, tie_break = list(by), list(tie_break)
    if drop_missing:
        df = df.where(F.col(signal).isNotNull() & ~F.isnan(signal))
    if n == 1:
        return df.withColumn(out, F.lit(1))
    order = [*by, signal, *tie_break]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of the id are the task, the lower ones the row within it.
    rows = durable(rows.withColumn("sort_pos", F.monotonically_increasing_id()), "ranked")
    task = F.shiftright("sort_pos", 33)
    runs = rows.groupBy(*by, task.alias("sort_task")).agg(
        F.min("sort_pos").alias("first_pos"), F.count(F.lit(1)).alias("run_rows")
    )
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("sort_task").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("run_rows").over(earlier), F.lit(0))
    starts = runs.select(
        *by, "sort_task", (before - F.col("first_pos")).alias("shift"), F.sum("run_rows").over(whole).alias("total")
    )
    placed = rows.withColumn("sort_task", task).alias("d").join(
        durable(starts, "runs").alias("q"), _same("d", "q", [*by, "sort_task"])
    )
    rank = F.col("d.sort_pos") + F.col("q.shift")
    return placed.select("d.*", _group_of(rank, F.col("q.total"), n).alias(out)).drop("sort_pos", "sort_task")
