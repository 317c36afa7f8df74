"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.text import WORD
from panelforge.storage import durable


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, ceiling: int) -> DataFrame:
    """``source, source_size, target`` of rows ``source, size``.

    Sources in code point order, null last, weigh ``weights`` in turn, again and again. They share ``share`` of
    all sizes by weight, no target above ``ceiling`` times its source's size; what a target cannot hold is
    shared by weight among the others until all fit. That is one water level: every target is its weight times
    the level, or its ceiling. With the sources in order of ceiling over weight, those before some point are
    full, which a running sum finds. Only one row per source is ordered, never documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(named) - 1) % len(weights) + 1)
    ceilings = totals.withColumn("weight", weight).withColumn("most", ceiling * F.col("source_size"))
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    full_before = F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ceilings.withColumn("level", (share * F.sum("source_size").over(whole) - full_before) / weight_left)
    fits = F.col("level") * F.col("weight") < F.col("most")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("most") / F.col("weight"))).over(whole)
    target = F.coalesce(F.least(level * F.col("weight"), F.col("most")), F.col("most").cast("double"))
    return levels.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number from 0 up to 1 that depends on the seed and the source alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def plan_copies(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, ceiling: int = 2, seed: int = 1
) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with ``size, source_size, target, copies``.

    A row's expected copies are its source's target over its size. Within a source, rows in order of ``size``
    and ``doc_id`` get the running sum of expected copies, shifted by one offset; a row is taken once for each
    whole number that the sum passes at it. So copies differ from expected by less than one, and the order by
    size keeps the words taken near the target.

    Ranks come from a range partitioning over source, size and id, which also splits a source that holds most
    rows: each task numbers its rows, and one count per task and source is summed up. Repeated rows are ranked
    each; rows equal in all three are interchangeable. A null or empty text has size 0 and takes no words; an
    empty table gives no rows. ``docs`` keeps all its columns in ``row``, whatever their names. Runs jobs when called.
    """
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("source"),
        F.col("doc_id").alias("id"),
        word_count(F.col("text")).alias("size"),
    )
    return _place(sized, weights, share, ceiling, seed)


def plan_sizes(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, ceiling: int = 2, seed: int = 1
) -> DataFrame:
    """``plan_copies`` without the texts: ``row`` holds ``doc_id`` only."""
    sized = docs.select(
        F.struct("doc_id").alias("row"), "source", F.col("doc_id").alias("id"), word_count(F.col("text")).alias("size")
    )
    return _place(sized, weights, share, ceiling, seed)


def _place(sized: DataFrame, weights: Sequence[int], share: float, ceiling: int, seed: int) -> DataFrame:
    order = [F.col("source").asc_nulls_last(), "size", "id"]
    ordered = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = durable(ordered.withColumn("number", F.monotonically_increasing_id()), "mixing")
    task = F.shiftright("number", 33)  # the id holds the task above its number in the task
    runs = ordered.groupBy("source", task.alias("task")).agg(
        F.min("number").alias("first"), F.count("*").alias("n"), F.sum("size").alias("size")
    )
    runs = durable(runs, "mixing-runs")
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("rank_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    targets = source_targets(runs.select("source", "size"), weights, share, ceiling).withColumnRenamed("source", "of")
    starts = offsets.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias("of"), F.col("task").alias("in_task"), "first", "rank_before", "source_size", "target"
    )
    rows = ordered.withColumn("task", task)
    rows = rows.join(starts, (F.col("task") == F.col("in_task")) & F.col("source").eqNullSafe(F.col("of")))
    rank = F.col("rank_before") + F.col("number") - F.col("first")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shift = offset(F.col("source"), seed)
    passed = F.floor(each * (rank + 1) + shift) - F.floor(each * rank + shift)
    copies = F.least(passed, F.ceil(each)).cast("int")  # rounding never adds a copy
    return rows.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken."""
    return plan_copies(docs, **options).where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies")))
    ).select("row.*")
