"""Quality rules: a document's character classes and common words against references of its language."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import map_batches, split_words
from panelforge.storage import durable

#: Frequent words of English, German, French and Spanish; every other word falls into one further bin.
COMMON_WORDS = (
    "the of and to in a is that it for on was be with as by this at are an from or have not "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine auch es "
    "de la le et les un du une que est pour qui dans par plus sur au pas ce il "
    "el en y los se del las por con no una su para al lo como más o"
).split()
CLASSES = ("lower", "upper", "digit", "blank", "stop", "mark", "symbol", "other")
SYMBOLS = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_chars")) + ", classes array<long>, common array<long>"
#: Triples of word numbers below this fit one signed 64-bit integer.
PACKED = 1 << 21
#: A document's histogram is brought to this total before it enters a reference, so that long ones do not rule it.
SCALE = 1_000_000


def _byte_classes() -> np.ndarray:
    """Class of each byte; a character beyond ASCII counts once, by its first byte, as ``other``."""
    table = np.full(256, CLASSES.index("symbol"), np.uint8)
    members = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789"}
    members |= {"blank": " \t\n\v\f\r", "stop": ".,", "mark": "!?;:'\"()-"}
    for name, letters in members.items():
        table[[ord(c) for c in letters]] = CLASSES.index(name)
    table[128:192] = len(CLASSES)  # inside a character
    table[192:] = CLASSES.index("other")
    return table


def repeated_words(codes: np.ndarray) -> int:
    """Words in any window of three that is found twice or more, the first included."""
    if len(codes) < 4:
        return 0
    if codes.max() >= PACKED:
        codes = np.unique(codes, return_inverse=True)[1]
    codes = codes.astype(np.int64)
    if codes.max() >= PACKED:
        pairs = np.unique(codes[:-1] * len(codes) + codes[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(codes) + codes[2:]
    else:
        windows = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.isin(windows, twice)
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[shift : shift + len(found)] |= found
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def _feature_batches() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    byte_class, common = _byte_classes(), pa.array(COMMON_WORDS)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column("text"), "")
        words = split_words(texts)
        known = pc.fill_null(pc.index_in(pc.ascii_lower(words.distinct), common), len(common))
        bins = known.to_numpy(zero_copy_only=False)[words.codes]
        lengths = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False)[words.codes]
        chars = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[words.ends]
        lists = texts.cast(pa.binary()).to_pylist()
        rows = list(zip(words.ends[:-1].tolist(), words.ends[1:].tolist(), lists, strict=True))
        classes = [np.bincount(byte_class[np.frombuffer(t, np.uint8)], minlength=len(CLASSES) + 1)[:-1] for *_, t in rows]
        shares = [np.bincount(bins[a:b], minlength=len(common) + 1) for a, b, _ in rows]
        symbols = pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64())
        columns = {
            "doc_id": batch.column("doc_id"),
            "lang": batch.column("lang"),
            "n_words": pa.array(np.diff(words.ends)),
            "word_chars": pa.array(np.diff(chars)),
            "n_symbols": symbols,
            "n_dup_lines": pa.array([duplicate_lines(t) if b"\n" in t else 0 for *_, t in rows], pa.int64()),
            "n_repeat_words": pa.array([repeated_words(words.codes[a:b]) for a, b, _ in rows], pa.int64()),
            "n_chars": pa.array([int(c.sum()) for c in classes], pa.int64()),
            "classes": pa.array(classes, pa.list_(pa.int64())),
            "common": pa.array(shares, pa.list_(pa.int64())),
        }
        return pa.record_batch(list(columns.values()), list(columns))

    return step


def document_features(docs: DataFrame) -> DataFrame:
    """Per row its counts and its two histograms, in one pass without a shuffle. A null text has no words."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    return map_batches(narrow, _feature_batches, FEATURES)


def fails_base(min_words: int, max_repeated: int) -> Column:
    """Too short, or more than ``max_repeated`` percent of the words in repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))


def _sum_batches() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang = batch.column("lang").dictionary_encode(null_encoding="encode")
        codes, width = lang.indices.to_numpy(zero_copy_only=False), len(lang.dictionary)
        sums = {}
        for name in ("classes", "common"):
            matrix = np.array(batch.column(name).to_pylist(), np.int64).reshape(batch.num_rows, -1)
            sums[name] = np.zeros((width, matrix.shape[1]), np.int64)
            np.add.at(sums[name], codes, SCALE * matrix // np.maximum(matrix.sum(1, keepdims=True), 1))
        columns = [lang.dictionary, pa.array(np.bincount(codes, minlength=width))]
        columns += [pa.array(list(sums[name]), pa.list_(pa.int64())) for name in ("classes", "common")]
        return pa.record_batch(columns, ["lang", "n", "classes", "common"])

    return step


def language_references(features: DataFrame, prior: float) -> DataFrame:
    """``ref_lang, ref_n, ref_classes, ref_common``: mean histograms by language, and of all under a null language.

    Every document has the same weight, in whole numbers, so that sums do not depend on their order. Each language's
    mean of ``ref_n`` documents is drawn towards that of all by ``prior`` documents more, at every number of rows; the
    reference of all has a ``ref_n`` of 0. Each batch is summed up before the shuffle, so a language that holds most
    rows costs no more than another.
    """
    partial = features.select("lang", "classes", "common").mapInArrow(
        lambda batches: map(_sum_batches(), (b for b in batches if b.num_rows)),
        "lang string, n long, classes array<long>, common array<long>",
    )
    bins = F.transform("classes", lambda n, i: F.struct(F.lit("classes").alias("kind"), i.alias("bin"), n.alias("count")))
    others = F.transform("common", lambda n, i: F.struct(F.lit("common").alias("kind"), i.alias("bin"), n.alias("count")))
    rows = partial.select("lang", "n", F.explode(F.concat(bins, others)).alias("b")).select("lang", "n", "b.*")
    by_lang = rows.groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"), F.sum("count").alias("count"))
    by_lang = durable(by_lang, "references")
    pooled = by_lang.groupBy("kind", "bin").agg((F.sum("count") / F.sum("n")).alias("mean"))
    own = by_lang.where("lang IS NOT NULL").join(pooled, ["kind", "bin"])
    drawn = own.select("lang", "n", "kind", "bin", (F.col("count") + prior * F.col("mean")).alias("count"))
    alone = pooled.select(F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("n"), "kind", "bin", F.col("mean").alias("count"))
    both = drawn.unionByName(alone)

    def histogram(kind: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("bin", "count"))))
        return F.transform(ordered, lambda x: x["count"]).alias(kind)

    found = both.groupBy("lang").agg(F.max("n").alias("ref_n"), histogram("classes"), histogram("common"))

    def shares(kind: str) -> Column:
        total = F.aggregate(kind, F.lit(0.0), lambda a, x: a + x)
        return F.transform(kind, lambda x: x / total).alias(f"ref_{kind}")

    return durable(found.select(F.col("lang").alias("ref_lang"), "ref_n", shares("classes"), shares("common")), "references")


def js_distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, with logarithms to base 2, of counts with their total to shares; null if one is empty."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def term(x: Column, q: Column) -> Column:
        p = x / total
        return part(p, (p + q) / 2) + part(q, (p + q) / 2)

    divergence = F.aggregate(F.zip_with(counts, reference, term), F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def distances(features: DataFrame, references: DataFrame) -> DataFrame:
    """Add ``class_distance`` and ``common_distance`` to the reference of the row's language, and its ``ref_n``.

    A row without a language, or with one that has no reference, is held against that of all rows, with a ``ref_n`` of 0.
    """
    pooled = references.where("ref_lang IS NULL").agg(F.first(F.struct("ref_classes", "ref_common"))).scalar()
    own = features.join(references, F.col("lang") == F.col("ref_lang"), "left").withColumn("pooled", pooled)
    return own.withColumns(
        {
            "ref_n": F.coalesce("ref_n", F.lit(0).cast("long")),
            "class_distance": js_distance(F.col("classes"), F.col("n_chars"), F.coalesce("ref_classes", F.col("pooled.ref_classes"))),
            "common_distance": js_distance(F.col("common"), F.col("n_words"), F.coalesce("ref_common", F.col("pooled.ref_common"))),
        }
    ).drop("ref_lang", "ref_classes", "ref_common", "pooled")


def judge_quality(
    docs: DataFrame,
    min_words: int = 50,
    max_repeated: int = 50,
    max_class_distance: float = 0.12,
    max_common_distance: float = 0.15,
    class_guard: float = 1.2,
    common_guard: float = 1.85,
    prior: float = 1.0,
) -> DataFrame:
    """Features of each row with ``base_failed``, ``class_distance``, ``common_distance`` and ``kept``.

    A row is dropped if it fails the base rules (fewer than ``min_words`` words, or repeated windows) or lies
    too far from the reference of its language: its class distance is above ``max_class_distance``, or its
    common-word distance above ``max_common_distance``. Short texts scatter more, so either limit is
    higher by its guard over the square root of the words. The reference of a language of n documents is drawn
    towards that of all by ``prior`` documents more, and both limits are higher by twice the share
    ``prior / (n + prior)``, so the fewer documents tell how a language looks, the further one has to be off.
    Without a language, or with one that no other row can vouch for, the limits are beyond the largest distance, 1: only
    the base rules judge. References come from all rows that pass the base rules, then once more from
    those of them that lie within the limits of the first ones, so that junk does not blur them.

    A null or empty text has no words and fails the base rules; repeated rows are judged alike; an empty table
    gives no rows. Only ``doc_id``, ``lang`` and ``text`` are read. Runs jobs when called.
    """
    base = fails_base(min_words, max_repeated)
    features = durable(document_features(docs).withColumn("base_failed", base), "features")
    root = F.sqrt(F.greatest("n_words", F.lit(1)))
    wider = 2 * prior / (F.col("ref_n") + prior)
    far = (F.col("class_distance") > max_class_distance + class_guard / root + wider) | (
        F.col("common_distance") > max_common_distance + common_guard / root + wider
    )
    near = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    first = language_references(features.where("NOT base_failed"), prior)
    second = language_references(distances(features, first).where(near), prior)
    measured = distances(features, second).withColumn("kept", near)
    return measured.select("doc_id", "lang", *COUNTS, "base_failed", "class_distance", "common_distance", "kept")
