"""As-of joins by merging two sorted tables: each row meets the latest row of the other table that is not later."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.storage import durable


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, known_at: str, take: Mapping[str, str], tie_break: Sequence[str] = ()
) -> DataFrame:
    """``left`` with columns of the latest row of ``right`` (same ``keys``, ``known_at`` not after ``time``), else NULL.

    ``take`` maps new names to columns of ``right``; of rows known at the same time the last by ``tie_break`` counts. Every left row
    stays once; a missing key or time meets nothing. Both tables need columns named as in ``keys``. Runs jobs when called.

    The tables are laid one into the other by range over key and time, so a key with most rows spreads over many tasks; nothing
    is repeated per period or candidate. In each task a row takes the last known row before it, and where a key begins in an
    earlier task, that of the nearest earlier task: one row per key and task.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    seen = F.struct(*(F.col(f"`{c}`").alias(name) for name, c in take.items()))
    shared = [F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
    ties = [F.col(c).alias(f"tie_{i}") for i, c in enumerate(tie_break)]
    known = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, known_at)))
    known = known.select(*shared, F.col(known_at).alias("at"), F.lit(0).alias("side"), *ties, seen.alias("seen"))
    asked = left.select(*shared, F.col(time).alias("at"), F.lit(1).alias("side"), row.alias("row"))
    order = [*(f"key_{i}" for i in range(len(keys))), "at", "side", *(f"tie_{i}" for i in range(len(tie_break)))]
    both = known.unionByName(asked, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order)
    both = durable(both.drop(*order[len(keys) + 2 :]).withColumn("number", F.monotonically_increasing_id()), "asof")
    both = both.withColumn("task", F.shiftright("number", 33))  # the id holds the task above the row's number in it

    of = order[: len(keys)]
    last = both.where("side = 0").groupBy(*of, "task").agg(F.max_by("seen", "number").alias("ended"))
    runs = both.select(*of, "task").distinct().join(last, [*of, "task"], "left")
    earlier = Window.partitionBy(*of).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select(*of, "task", F.last("ended", ignorenulls=True).over(earlier).alias("carried"))
    here = Window.partitionBy(*of, "task").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("met", F.last("seen", ignorenulls=True).over(here)).where("side = 1")
    # Keys that are missing have no run to join, and stay by the left join.
    found = merged.join(durable(carried, "asof-runs"), [*of, "task"], "left")
    whole = F.col("at").isNotNull()
    for name in of:
        whole = whole & F.col(name).isNotNull()
    latest = F.when(whole, F.coalesce("met", "carried"))
    return found.select("row.*", *(latest[name].alias(name) for name in take))
