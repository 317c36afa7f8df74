"""Near copies by b-bit MinHash over word shingles, with exact confirmation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.components import components
from panelforge.llm.text import SMALL_SLICE, give_back, map_batches, split_words
from panelforge.storage import durable, release

#: Minima per document, packed to ``BITS`` low bits each.
MINIMA, BITS = 512, 2
LONGS = MINIMA * BITS // 64
#: The first minima also form bands of ``ROWS``. Two sets of similarity 0.8 miss all bands 1 time in 20 million.
BANDS, ROWS = 32, 4
#: A pair is compared exactly if its estimate is at most this many standard deviations below the limit.
DEVIATIONS = 4
#: Before the rows outside a bucket's largest component meet all others, they meet so many rows of it.
PIVOTS = 4
MASK = 0x5555555555555555
SIGNATURE = [f"s{i}" for i in range(LONGS)]
SCHEMA = "doc_id long, n_shingles long, set_key binary, bands array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers over their whole range (the finishing steps of a common hash function)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 1 << 31, (MINIMA, 1), np.uint32) * np.uint32(2) + np.uint32(1)
    return factors, rng.integers(0, 1 << 32, (MINIMA, 1), np.uint32)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its ``k``-word shingles, A-Z in lower case.

    A text with fewer words has its whole sequence as the one shingle; one without words has none.
    """
    words = split_words(texts, lower=True)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.distinct.cast(pa.binary()).to_pylist()), np.uint64, len(words.distinct))
    stream, sets = hashes[words.codes], []
    for a, b in zip(words.ends[:-1].tolist(), words.ends[1:].tolist(), strict=True):
        own, width = stream[a:b], min(k, b - a)
        if not width:
            sets.append(own)
            continue
        value = np.full(b - a - width + 1, np.uint64(width))
        for i in range(width):
            value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + own[i : i + len(value)])
        value.sort()
        sets.append(value[np.append(True, value[1:] != value[:-1])])
    return sets


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of ``MINIMA`` permutations of 32-bit integers."""
    factors, shifts = _permutations()
    least, x = np.full(MINIMA, np.uint32(0xFFFFFFFF)), shingles.astype(np.uint32)
    for i in range(0, len(x), 512):
        least = np.minimum(least, (factors * x[i : i + 512] + shifts).min(axis=1))
    return least


def _signature_batches(k: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    band = np.arange(BANDS, dtype=np.uint64)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), k)
        least = np.array([minima(s) for s in sets], np.uint32).reshape(-1, MINIMA)
        keys = np.broadcast_to(_mix(band + np.uint64(1)), (len(sets), BANDS)).copy()
        for row in range(ROWS):
            keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, row : BANDS * ROWS : ROWS])
        low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(sets), LONGS, -1)
        packed = (low << (np.arange(low.shape[2], dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)
        full = np.array([len(s) > 0 for s in sets], bool)
        columns = [
            batch.column("doc_id"),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([b if f else None for b, f in zip(keys.view(np.int64), full, strict=True)], pa.list_(pa.int64())),
            *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(LONGS)),
        ]
        return pa.record_batch(columns, ["doc_id", "n_shingles", "set_key", "bands", *SIGNATURE])

    return step


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per row the size of its set, a 128-bit key of the set, band keys, and the packed low bits of its minima."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), partial(_signature_batches, k), SCHEMA, SMALL_SLICE)


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: the share of equal minima, by bit counts, corrected for low bits
    that agree by chance."""

    def differing(i: int) -> Column:
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        any_bit = x
        for shift in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(any_bit.bitwiseAND(F.lit(MASK)))

    equal = (MINIMA - sum(differing(i) for i in range(LONGS))) / F.lit(float(MINIMA))
    chance = 1.0 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether the sizes allow the similarity, and the estimate is not far below it."""
    limit, chance = percent / 100, 1 / (1 << BITS)
    equal = limit + (1 - limit) * chance
    spread = (equal * (1 - equal) / MINIMA) ** 0.5 / (1 - chance)
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (100 * small >= percent * large) & (estimate(a, b) >= limit - DEVIATIONS * spread)


def _confirm_batches(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                both = [shingle_sets(part.column(c).dictionary_encode().dictionary, k) for c in ("text_a", "text_b")]
                codes = [part.column(c).dictionary_encode().indices.to_pylist() for c in ("text_a", "text_b")]
                linked = []
                for a, b in zip(*codes, strict=True):
                    x, y = both[0][a], both[1][b]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
            give_back()

    return run


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose whole shingle sets have the similarity."""
    named = texts.select(F.col("doc_id").alias("id"), "text")
    rows = pairs.join(named.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    rows = rows.join(named.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(_confirm_batches(k, percent), "a long, b long")


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept``: documents are linked if 100 times the shingles they
    share are at least ``percent`` times those of both, and a component is all that links reach.

    Documents with equal sets are one class, of which the least id takes part further, so exact copies are
    never paired. Classes that share a band meet in its bucket: first all are compared with the bucket's
    least, a comparison per member. Those outside the bucket's largest component are then compared with a few of its
    classes, so that a group of near copies that not all are like its least joins without a comparison of all
    pairs. After the components of the links found, the classes of a bucket's smaller
    components are compared with those of its other ones, each pair in the first bucket that it shares, so no
    pair between components is left out, and a component that fills a bucket is not compared with itself. A
    pair that its signatures rule out is dropped at once; for others whole texts decide.

    A null or empty text, or one without words, has an empty set and is linked with nothing. Rows that share
    an id are one document, linked by any of its texts. A null id takes its class's component, and is null
    where the class has no other; ``kept`` is true where ``doc_id`` equals ``component_id``. Other columns
    are left out. An empty table gives no rows. Runs jobs when called.
    """
    rows = durable(signatures(docs, k), "signatures")
    classes = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"))
    classes = durable(classes, "classes").where("rep IS NOT NULL")
    keyed = rows.withColumnRenamed("set_key", "own_key").drop("n_shingles")
    reps = keyed.join(classes, (F.col("own_key") == F.col("set_key")) & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["rep", "set_key"])
    reps = durable(reps.select("rep", "n_shingles", "bands", *SIGNATURE), "representatives")
    slim = reps.select(F.struct("rep", "n_shingles", *SIGNATURE).alias("x"))
    wide = reps.select(F.struct("rep", "n_shingles", "bands", *SIGNATURE).alias("x"))

    members = reps.select("rep", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    members = durable(members.join(shared.select("band", "hub"), "band"), "buckets")

    def with_signature(pairs: DataFrame, id_column: str, name: str, signed: DataFrame = slim) -> DataFrame:
        return pairs.join(signed.withColumnRenamed("x", name), F.col(id_column) == F.col(f"{name}.rep"))

    def plausible(pairs: DataFrame) -> DataFrame:
        return with_signature(with_signature(pairs, "b", "y"), "a", "x").where(may_link("x", "y", percent))

    met = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = durable(docs.select(F.col("doc_id").cast("long"), "text").join(met, "doc_id", "left_semi"), "texts")

    def joined(found: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """The components with the confirmed ones of ``pairs``, in place of ``found``."""
        pairs = durable(pairs, "pairs")
        links = confirm(pairs, texts, k, percent)
        if found is not None:
            links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
        after = durable(components(links), "components")
        release(pairs, *([] if found is None else [found]))
        return after

    def in_mixed(found: DataFrame) -> DataFrame:
        """The rows of the buckets that hold several components: ``band, main, component, x``; ``main`` has the most rows."""
        placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        placed = placed.withColumn("component", F.coalesce("component", "rep"))
        sizes = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
        mixed = mixed.where("parts > 1").select("band", "main")
        left = with_signature(placed.join(mixed, "band"), "rep", "z", wide)
        return durable(left.select("band", "main", "component", F.col("z").alias("x")), "mixed")

    stars = members.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    found = joined(None, plausible(stars).select("a", "b").distinct())
    left = in_mixed(found)
    order = [F.xxhash64("x.rep", F.lit(i)) for i in range(PIVOTS)]
    chosen = left.where("component = main").groupBy("band").agg(F.array_distinct(F.array(*(F.min_by("x", o) for o in order))).alias("y"))
    near = left.where("component != main").join(chosen.select("band", F.explode("y").alias("y")), "band").where(may_link("x", "y", percent))
    found = joined(found, near.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())
    release(left)
    left = in_mixed(found)
    minor = left.where("component != main").select("band", "component", "x")
    other = left.select("band", F.col("component").alias("other"), (F.col("component") == F.col("main")).alias("in_main"), F.col("x").alias("y"))
    # in the order of their cost; the last one keeps a pair in the first bucket that it shares
    once = (F.col("in_main") | (F.col("x.rep") < F.col("y.rep"))) & may_link("x", "y", percent)
    first = F.array_intersect("x.bands", "y.bands")[0] == F.col("band")
    apart = (F.col("component") != F.col("other")) & once & first
    across = minor.join(other, "band").where(apart)
    found = joined(found, across.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")))

    release(left, members, texts, reps)

    merged = classes.join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    ids = rows.select("doc_id", "n_shingles", "set_key").join(merged, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return ids.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
