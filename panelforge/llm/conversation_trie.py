"""A trie of conversations by their first turns, from whole sequences collapsed to weighted ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.storage import durable

#: A conversation takes over at most so many turns, less one, of the first one of its family.
HEAD = 9
FAMILY = 5
#: Running values along a sequence are made for so many turns at a time, so that a window is bounded.
BLOCK = 4096
#: So many numbers of conversations are joined into one row on the way to the digest of all of them.
LISTED = 512
#: What tells a node: its depth, and two digests of 64 bits of all turns down to it.
NODE = ("depth", "x1", "x2")


def head_turns(conv_id: str = "conv_id") -> Column:
    """How many turns a conversation takes over."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEAD).cast("long")


def _first_of_family(conv_id: str) -> Column:
    return F.col(conv_id) - F.col(conv_id) % FAMILY


def _numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, pos, said, bytes`` with their rows' positions from 1, and ``conv_id, n``.

    Positions come from a range partitioning over id and turn, which also splits a conversation that holds most rows; each
    task numbers its rows, and one count per task and conversation is summed up.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "said"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn")
    ordered = durable(ordered.withColumn("number", F.monotonically_increasing_id()), "turns")
    task = F.shiftright("number", 33)  # the id holds the task above its number in the task
    runs = durable(ordered.groupBy("conv_id", task.alias("task")).agg(F.min("number").alias("first"), F.count("*").alias("n")), "turn-runs")
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("conv_id", "task", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = ordered.withColumn("task", task).join(starts, ["conv_id", "task"])
    pos = F.col("before") + F.col("number") - F.col("first") + 1
    return placed.select("conv_id", pos.alias("pos"), "said", "bytes"), runs.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv_id, depth, x1, x2, bytes`` (stored), and every ``conv_id``, also those left without a turn.

    Conversation c gets the first h turns of that of c - c % 5, then its own after its first h. The digests are of role, text and depth.
    """
    placed, counts = _numbered(conversations)
    placed = durable(placed, "placed")
    counts = durable(counts.withColumn("h", head_turns()), "turn-counts")
    firsts = counts.select(F.col("conv_id").alias("of"), F.col("n").alias("n_first"))
    taken = F.least("h", F.coalesce("n_first", F.lit(0)))
    plans = counts.join(firsts, _first_of_family("conv_id") == F.col("of"), "left").select("conv_id", "h", taken.alias("taken"))

    is_first = F.col("conv_id") % FAMILY == 0
    own = placed.where(~is_first & (F.col("pos") > head_turns())).join(plans, "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "said", "bytes")
    whole = placed.where(is_first).withColumnRenamed("pos", "depth")
    steps = F.array(*(F.lit(k).cast("long") for k in range(1 - FAMILY, FAMILY) if k))
    sibling = F.explode(F.transform(steps, lambda k: F.try_add(F.col("conv_id"), k)))
    heads = placed.where(is_first & (F.col("pos") < HEAD)).select(F.col("conv_id").alias("of"), sibling.alias("conv_id"), "pos", "said", "bytes")
    heads = heads.where((_first_of_family("conv_id") == F.col("of")) & (F.col("pos") <= head_turns()))
    heads = heads.join(counts, "conv_id", "left_semi").select("conv_id", F.col("pos").alias("depth"), "said", "bytes")

    rebuilt = whole.select(own.columns).unionByName(own).unionByName(heads)
    x1, x2 = (F.xxhash64(F.lit(k), "depth", "said") for k in (1, 2))
    return durable(rebuilt.select("conv_id", "depth", x1.alias("x1"), x2.alias("x2"), "bytes"), "rebuilt"), counts.select("conv_id")


def collapse(rebuilt: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation's sequence ``conv_id, depth, x1, x2``, and the distinct ones with ``weight`` and least ``rep`` (both stored)."""
    sums = rebuilt.groupBy("conv_id").agg(
        F.count("*").alias("depth"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("bytes").alias("total")
    )
    filled = {c: F.coalesce(c, F.lit(0).cast("long")) for c in (*NODE, "total")}
    whole = durable(convs.join(sums, "conv_id", "left").withColumns(filled), "sequences")
    distinct = whole.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("rep"), F.max("total").alias("total"))
    return whole, durable(distinct, "distinct-sequences")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of conversations, joined by sequence into lists of at most ``LISTED`` numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy() for c in NODE])
        new = np.append(True, (keys[1:] != keys[:-1]).any(1))
        at = np.arange(len(new))
        since = at - np.maximum.accumulate(np.where(new, at, 0))
        starts = np.flatnonzero(since % LISTED == 0)
        names = batch.column("conv_id").cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(new)), pa.int32()), names)
        rows = batch.take(pa.array(starts))
        yield pa.record_batch([*rows.columns, pc.binary_join(lists, ",")], [*rows.schema.names, "listed"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per sequence, of its sorted lists; only the running digest is held."""
    key, digest = None, None

    def made(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])

    for batch in batches:
        done = []
        for *own, listed in zip(*(batch.column(c).to_pylist() for c in (*NODE, "listed")), strict=True):
            if own == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256()
            digest.update(listed.encode())
        if done:
            yield made(done)
    if key is not None:
        yield made([(*key, digest.hexdigest())])


def end_digests(whole: DataFrame) -> DataFrame:
    """``depth, x1, x2, ends_sha256`` of the conversations of each sequence, ascending.

    They are sorted by range over sequence and number, which splits a sequence of very many conversations, and joined into lists there. A SHA-256
    is made from front to back, so the lists of one sequence go through one task in order, which holds none of them.
    """
    order = [*NODE, "conv_id"]
    ids = whole.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    listed = durable(ids.mapInArrow(_listed, "depth long, x1 long, x2 long, conv_id long, listed string"), "end-lists")
    return listed.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(_digests, "depth long, x1 long, x2 long, ends_sha256 string")


def prefixes(rebuilt: DataFrame, distinct: DataFrame) -> DataFrame:
    """All prefixes of the distinct sequences, the empty one included (stored).

    ``rep, depth, x1, x2, p1, p2`` (digests here and one turn before), ``bytes`` before this turn as ``before``, and ``deepest``,
    the sequence's depth. Running values are made in blocks of ``BLOCK`` turns; only longer sequences add up the blocks before.
    """
    named = distinct.select(F.col("rep").alias("conv_id"), F.col("depth").alias("deepest"))
    turns = rebuilt.join(named, "conv_id").withColumn("block", F.expr(f"(depth - 1) div {BLOCK}"))
    sums = (F.bit_xor("x1").alias("a1"), F.bit_xor("x2").alias("a2"), F.sum("bytes").alias("ab"))
    blocks = turns.where(F.col("deepest") > BLOCK).groupBy("conv_id", "block").agg(*sums)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "conv_id", "block", F.bit_xor("a1").over(earlier).alias("a1"), F.bit_xor("a2").over(earlier).alias("a2"), F.sum("ab").over(earlier).alias("ab")
    )
    running = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    ran = turns.select(
        "conv_id", "block", "depth", "deepest", "x1", "x2", "bytes",
        F.bit_xor("x1").over(running).alias("r1"), F.bit_xor("x2").over(running).alias("r2"), F.sum("bytes").over(running).alias("rb"),
    ).join(durable(starts, "blocks"), ["conv_id", "block"], "left")
    here1, here2 = (F.col(f"r{k}").bitwiseXOR(F.coalesce(f"a{k}", F.lit(0).cast("long"))) for k in (1, 2))
    found = ran.select(
        F.col("conv_id").alias("rep"), "depth", here1.alias("x1"), here2.alias("x2"),
        here1.bitwiseXOR(F.col("x1")).alias("p1"), here2.bitwiseXOR(F.col("x2")).alias("p2"),
        (F.col("rb") + F.coalesce("ab", F.lit(0)) - F.col("bytes")).alias("before"), "deepest",
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = distinct.select(
        "rep", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"), zero.alias("before"), F.col("depth").alias("deepest")
    )
    return durable(found.unionByName(roots), "prefixes")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations. Runs jobs when called.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Identical rebuilt conversations are one weighted sequence. Those that are no proper prefix of another one, found by an anti-join, are the
    leaves. All else are sums over the prefixes of the distinct sequences: members by weight; what a subtree saves is the
    bytes of all members from its top on, less those of its distinct nodes, and each node belongs to the sequence of its least
    member, which holds all its nodes from one depth on.

    Turns with equal ``turn`` are ordered by the SHA-256 of role and text (null ones as empty). Rows without a ``conv_id`` belong to
    no conversation; repeated rows are turns of their own; other columns are not read. An empty table has no node. A text
    of any length is read once, for its digest. Nodes are told by depth and 128 bits of digests.
    """
    rebuilt, convs = rebuilt_turns(conversations)
    whole, distinct = collapse(rebuilt, convs)
    paths = prefixes(rebuilt, distinct)
    interior = paths.where("depth < deepest").select(*NODE).distinct()
    leaves = distinct.join(interior, list(NODE), "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))

    owners = paths.groupBy(*NODE).agg(F.min(F.struct("rep", "before")).alias("own")).select("own.rep", "depth", "own.before")
    tops = owners.groupBy("rep").agg(F.min(F.struct("depth", "before")).alias("top")).select(
        "rep", F.col("top.depth").alias("top_depth"), F.col("top.before").alias("top_before")
    )
    known = distinct.select("rep", "weight", "total").join(tops, "rep", "left").join(leaves, "rep", "left")
    known = durable(known.withColumns({"top_before": F.coalesce("top_before", "total"), "leaf": F.coalesce("leaf", F.lit(0))}), "sequence-facts")
    kept = F.col("weight") * (F.col("total") - F.col("before")) - (F.col("total") - F.greatest("before", "top_before"))
    nodes = paths.join(known, "rep").groupBy(*NODE).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(kept).alias("saved_tokens"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.bool_or(F.coalesce(F.col("depth") == F.col("top_depth"), F.lit(False))).alias("top"),
    )
    nodes = durable(nodes, "nodes")

    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    children = below.agg(F.count("*").alias("n_children"))
    # Only the top of a sequence's own nodes hangs from another sequence's node. One node may have most tops below it: stored
    # right after the join, so that the join alone is split where it is skewed.
    above = nodes.select((F.col("depth") + 1).alias("at"), F.col("x1").alias("u1"), F.col("x2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    hung = nodes.where("top AND depth > 0").join(above, (F.col("depth") == F.col("at")) & (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2")))
    hung = durable(hung.select(*nodes.columns, "parent_conv_id"), "hung")
    inner = nodes.where("NOT top OR depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    found = hung.unionByName(inner).join(children, list(NODE), "left").join(durable(end_digests(whole), "ends"), list(NODE), "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
