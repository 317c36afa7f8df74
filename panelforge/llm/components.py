"""Connected components of a table of links, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.storage import durable, release


def _directed(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(around: DataFrame, larger: bool) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to the least one of its neighbourhood."""
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    near = around.join(least, "u")
    if larger:
        moved = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        smaller = near.where(F.col("v") < F.col("u"))
        moved = smaller.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            smaller.select("u", F.col("least").alias("v"))
        )
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` of every node of ``links`` (``a``, ``b``); ``component`` is the least node reachable.

    Alternating large and small stars keep the components and bring every node nearer to its least one, in a
    number of rounds that grows with the logarithm of the nodes. Each round is a stored table, so a lost
    executor costs one round, and only a count and a checksum come to the driver. Links of a node with itself
    and null ends are left out. Runs jobs when called.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now, seen = durable(pairs, label), None
    while True:
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == tuple(total):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = tuple(total)
        large = _star(_directed(now), larger=True)
        last, now = now, durable(_star(large, larger=False), label)
        release(last)
