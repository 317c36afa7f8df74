"""Token ids in ORC files that can be read stripe by stripe and pruned by document id."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.text import Memo, map_batches, split_words
from panelforge.storage import shuffles_removed

#: Columns of a token file. ``place`` is the number of ids of earlier documents in the same file.
FILE_SCHEMA = "doc_id long, place long, tokens array<int>"
STEM_MEMO = 200_000
#: Marks that a tokenizer with word ends cuts off behind a letter.
STEM = r"^(?P<stem>(?s:.)*[a-z0-9])(?P<marks>[.,!?;:*%&$#|]*)$"


class WordEncoder:
    """Ids of whole texts from a tokenizer that drops white space, so that words can be encoded one by one.

    Such a tokenizer never joins characters across white space: the ids of a text are those of its words in
    turn. If it also lower-cases and cuts between a letter and a mark (tried out at the start), a word's ids
    are those of its lower-case stem and of the marks behind it. Stems new to the memo are encoded by the
    library itself, many in a call. A word that holds a special token's opening is kept whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stems = Memo(self._encode, STEM_MEMO)
        whole, stem, marks = (self._encode([w])[0] for w in (b"Thence!.", b"thence", b"!."))
        self.cuts = whole == stem + marks

    def _encode(self, words: list[bytes]) -> list[bytes]:
        if len(words) > 1000:
            return [ids for k in range(0, len(words), 1000) for ids in self._encode(words[k : k + 1000])]
        encoded = self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4").tobytes()
        lengths = np.fromiter((len(w.decode()) + 1 for w in words), np.int64, len(words))
        starts = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(encoded.ids))
        owner = np.searchsorted(np.cumsum(lengths), starts, "right")
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(words)))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _split_marks(self, distinct: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Of each word its stem and the marks behind it."""
        none = pa.array([""] * len(distinct))
        if not self.cuts:
            return distinct, none
        lower = pc.ascii_lower(distinct)
        found = pc.extract_regex(lower, STEM)
        special = pc.match_substring(distinct, "<|")
        cut = pc.and_not(pc.is_valid(found), special)
        stem = pc.if_else(cut, pc.struct_field(found, "stem"), pc.if_else(special, distinct, lower))
        return stem, pc.if_else(cut, pc.struct_field(found, "marks"), none)

    def ids_of(self, distinct: pa.Array) -> pa.Array:
        """Of each word its ids, as little-endian unsigned 32-bit integers."""
        both = pa.concat_arrays(self._split_marks(distinct)).dictionary_encode()
        table = self.stems.results(both.dictionary.cast(pa.binary()).to_pylist())
        ids = pa.array(table, pa.large_binary()).take(both.indices)
        return pc.binary_join_element_wise(ids[: len(distinct)], ids[len(distinct) :], pa.scalar(b"", pa.large_binary()))

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, each followed by ``end_id``, and where each text's ids end."""
        words = split_words(texts)
        end = pa.array([np.array([end_id], "<u4").tobytes()], pa.large_binary())
        table = pa.concat_arrays([self.ids_of(words.distinct), end])
        found = table.take(pa.array(np.insert(words.codes, words.ends[1:], len(table) - 1)))
        bounds = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)
        ids = np.frombuffer(found.buffers()[2], "<u4", bounds[-1] // 4)
        return ids, np.concatenate([[0], bounds[words.ends[1:] + np.arange(1, len(texts) + 1)] // 4])


word_encoder = lru_cache(maxsize=1)(WordEncoder)  # kept by a Python worker from task to task


def _encode_batches(path: str, end_id: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    encode, place = word_encoder(path), 0

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal place
        ids, ends = encode(batch.column("text"), end_id)
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))
        places = pa.array(place + ends[:-1], pa.int64())
        place += int(ends[-1])
        return pa.record_batch([batch.column("doc_id"), places, tokens], ["doc_id", "place", "tokens"])

    return step


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    stripe_bytes: int = 64 << 20,
    index_rows: int = 1000,
    false_positives: float = 0.01,
) -> None:
    """Encode ``doc_id``, ``text`` and write the ids in ascending ``doc_id`` order, over all files in name order.

    The text, not the far longer ids, is dealt by range of ``doc_id``; each task then encodes and writes its
    range. Equal ids (repeated rows, null ids first) are ordered by a hash of the text, which also splits an id
    that holds many rows. ORC stores the ids run-length and bit-packed, an index entry for every ``index_rows``
    rows and a Bloom filter on ``doc_id``, so a reader skips stripes and row groups that cannot hold an id.

    A null or empty text gives the end id alone; an empty table gives files without rows; other columns are
    left out. ``tokenizer`` must be a file that every executor has, of a tokenizer that drops white space.
    """
    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", tie)
    ordered = ordered.sortWithinPartitions("doc_id", tie)
    encoded = map_batches(ordered, partial(_encode_batches, tokenizer, end_id), FILE_SCHEMA)
    options = {
        "compression": "zstd",
        "orc.stripe.size": str(stripe_bytes),
        "orc.create.index": "true",
        "orc.row.index.stride": str(index_rows),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": str(false_positives),
    }
    with shuffles_removed(docs.sparkSession):
        encoded.write.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``place``, ``tokens`` and the number of the file, which counts up with ``doc_id``."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return spark.read.schema(FILE_SCHEMA).orc(path).select("doc_id", "place", "tokens", number.alias("file"))


def _digest_batches() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = batch.column("tokens")
        ids = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        ends = tokens.offsets.to_numpy().astype(np.int64)
        sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        columns = [batch.column(c) for c in ("doc_id", "file", "place")]
        columns += [pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())]
        return pa.record_batch(columns, ["doc_id", "file", "place", "n_tokens", "ids_crc32"])

    return step


def digest_token_files(files: DataFrame) -> DataFrame:
    """Per document its length and checksum, from the ids as read: ``doc_id, file, place, n_tokens, ids_crc32``."""
    return map_batches(files, _digest_batches, "doc_id long, file int, place long, n_tokens long, ids_crc32 long")


def with_starts(digests: DataFrame) -> DataFrame:
    """Add ``start``, the ids before a document over all files: one total per file is summed up, not the rows."""
    totals = digests.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("base"))
    return digests.join(bases, "file").withColumn("start", F.col("base") + F.col("place"))
