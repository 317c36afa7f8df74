"""Quality scores from compression: which of two dictionaries, of good and of bad text, makes a text smaller."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import map_batches, map_rows, text_crc
from panelforge.storage import durable

#: Texts are compressed in pieces of this many bytes, each by itself, so that the dictionary matters all along.
PIECE_BYTES = 1024
LEVEL = 3
#: Sizes of a text, in bytes: as it is, with the good dictionary, with the bad one.
SIZES = "n_bytes long, good_size long, bad_size long"


@dataclass(frozen=True)
class Classifier:
    """Two dictionaries and the coefficients that turn sizes into a probability."""

    good: bytes
    bad: bytes
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_dict_id=False)


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]


def sizes_of(text: bytes, good: bytes, bad: bytes) -> tuple[int, int, int]:
    """Bytes of a text, and of its pieces compressed with either dictionary."""
    cut, by_good, by_bad = pieces(text), _compressor(good), _compressor(bad)
    return len(text), sum(len(by_good.compress(p)) for p in cut), sum(len(by_bad.compress(p)) for p in cut)


def _size_batches(good: bytes, bad: bytes) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
        sizes = [sizes_of(text, good, bad) for text in texts]
        columns = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        columns += [pa.array([s[k] for s in sizes], pa.int64()) for k in range(3)]
        return pa.record_batch(columns, [*names, "n_bytes", "good_size", "bad_size"])

    return step


def compressed_sizes(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """``rows`` with ``text`` replaced by its three sizes; whole texts, piece by piece; null is empty."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return map_batches(rows, partial(_size_batches, good, bad), f"{kept}, {SIZES}")


def _terms(n: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The size difference by byte and by compressed byte, the compressed share, the length, and products."""
    by_byte = (bad - good) / np.maximum(n, 1)
    share, length = good / np.maximum(n, 1), np.log1p(n)
    relative = (bad - good) / np.maximum(bad + good, 1)
    return np.column_stack([by_byte, relative, share, length, by_byte * length, share * length, np.abs(by_byte), share**2])


def _train(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of too few samples, their bytes themselves."""
    if sum(map(len, samples)) > 8 * size:
        return zstandard.train_dictionary(size, samples).as_bytes()
    return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Newton's method with a small ridge, for a bounded number of rows, each of which counts so many ``times``."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (times * p * (1 - p))[:, None]).T @ x
        w += np.linalg.solve(hessian + ridge * np.eye(len(w)), x.T @ (times * (y - p)) - ridge * w)
    return w


def _marks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``marked, label, order`` of the rows of ``docs`` to learn from. Of several labels the lowest counts; null ones do not."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (text_crc() % 5 != 0))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("marked")).agg(F.min("quality").cast("int").alias("label"))
    ids = docs.select(F.col("doc_id").cast("long").alias("marked"))
    return marks.join(ids, "marked", "left_semi").withColumn("order", F.xxhash64("marked"))


def _sample(docs: DataFrame, marks: DataFrame, dictionary_rows: int, calibration_rows: int) -> DataFrame:
    """Texts of the sampled labels. At most ``2 * (dictionary_rows + calibration_rows)`` ids are broadcast, so the
    texts are not shuffled."""
    half, chosen = F.pmod("order", F.lit(2)), []
    for label in (0, 1):
        for use, part, most in (("calibration", 1, calibration_rows), ("dictionary", 0, dictionary_rows)):
            own = marks.where((F.col("label") == label) & (half == part)).orderBy("order").limit(most)
            chosen.append(own.withColumn("use", F.lit(use)))
    chosen = reduce(DataFrame.unionByName, chosen)
    rows = docs.select(F.col("doc_id").cast("long"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("marked")).select("order", "label", "use", "data")


def _pieces(sample: DataFrame, label: int, most: int) -> list[bytes]:
    count = F.ceil(F.octet_length("data") / PIECE_BYTES).cast("int")
    own = sample.where((F.col("label") == label) & (F.octet_length("data") > 0))
    cut = own.select("order", "data", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    found = cut.select(F.xxhash64("order", "i").alias("at"), F.substring("data", F.col("i") * PIECE_BYTES + 1, PIECE_BYTES).alias("piece"))
    return [bytes(r["piece"]) for r in found.orderBy("at", "piece").limit(most).select("piece").collect()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    dictionary_bytes: int = 65536,
    dictionary_rows: int = 3000,
    dictionary_pieces: int = 8192,
    calibration_rows: int = 6000,
) -> Classifier | None:
    """Learn from labelled rows that are not held out; null if a class has none. Runs jobs when called.

    The sample is bounded: per class ``dictionary_rows`` labels, of whose texts ``dictionary_pieces`` pieces
    (of ``PIECE_BYTES``) train a dictionary, and ``calibration_rows`` other labels, whose sizes a logistic
    regression is fitted on, each class weighed to its share of all labels. Labels without a row of ``docs`` do not
    count. All are taken in order of a hash, so reruns agree. Only the sample comes to the driver. If a class is
    missing from one half of the labels, the other half serves for both.
    """
    marks = durable(_marks(docs, labels), "marks")
    sample = durable(_sample(docs, marks, dictionary_rows, calibration_rows), "labelled")
    dictionaries = {}
    for label in (0, 1):
        own = _pieces(sample.where("use = 'dictionary'"), label, dictionary_pieces) or _pieces(sample, label, dictionary_pieces)
        if not own:
            return None
        dictionaries[label] = _train(own, dictionary_bytes)

    def sizes(rows: DataFrame) -> np.ndarray:
        own = [rows.where(F.col("label") == label).orderBy("order", "data").limit(calibration_rows) for label in (0, 1)]
        texts = own[0].unionByName(own[1]).select("label", F.col("data").cast("string").alias("text"))
        sized = compressed_sizes(texts, dictionaries[1], dictionaries[0]).select("label", "n_bytes", "good_size", "bad_size")
        found = np.array(sized.collect(), float).reshape(-1, 4)
        return found[np.lexsort(found.T[::-1])]

    found = sizes(sample.where("use = 'calibration'"))
    if len(set(found[:, 0])) < 2:
        found = sizes(sample)
    terms = _terms(*found[:, 1:].T)
    center, scale = terms.mean(0), terms.std(0) + 1e-9
    x = np.column_stack([np.ones(len(terms)), (terms - center) / scale])
    true = {row["label"]: row["count"] for row in marks.groupBy("label").count().collect()}
    used = found[:, 0].astype(int)
    times = np.array([true[label] for label in used]) / np.bincount(used)[used]
    weights = _logistic(x, found[:, 0], times * len(times) / times.sum())
    return Classifier(dictionaries[1], dictionaries[0], tuple(center), tuple(scale), tuple(weights))


def _score_batches(model: Classifier, name: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    sizes = _size_batches(model.good, model.bad)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sized = sizes(batch)
        n, good, bad = (sized.column(c).to_numpy().astype(float) for c in ("n_bytes", "good_size", "bad_size"))
        x = (_terms(n, good, bad) - model.center) / model.scale
        logit = model.weights[0] + x @ np.array(model.weights[1:])
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        columns = [batch.column(c) for c in batch.schema.names] + [pa.array(score)]
        return pa.record_batch(columns, [*batch.schema.names, name])

    return step


def score(rows: DataFrame, model: Classifier | None, name: str = "quality_score") -> DataFrame:
    """``rows`` (with a ``text``) and their score from 0 to 1 as column ``name``; the text is the only input.

    A null or empty text gets the score of sizes of zero. Repeated rows get equal scores; an empty table gives
    no rows; other columns stay as they are, so ``name`` must not be one of them. Without a model, where a
    class had no labelled row, every score is 0.5.
    """
    if name in rows.columns:
        raise ValueError(f"the rows have a column {name} already")
    if model is None:
        return rows.withColumn(name, F.lit(0.5))
    return map_rows(rows, partial(_score_batches, model, name), f"{name} double")
