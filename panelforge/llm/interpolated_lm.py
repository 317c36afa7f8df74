"""A word bigram model by deleted interpolation, and the scores of texts under it.

The probability of a token after another mixes three estimates: the token's share among what follows the other
in the training text, its share of all tokens, and an even one. The weights depend on how often the other token
occurs (buckets by powers of two) and are learned by expectation-maximisation: a part of the training text is
left out of the counts and the weights are those under which that part is most likely.

Every word and every pair of neighbouring words has its own count. Texts are worked on in slices. A slice sends the
sorted distinct keys of its words and pairs, with its own counts, in one block per range of keys; a task merges the
blocks of a range and answers each block with the counts over all slices, in the block's order. So a key travels once
per slice, whatever it occurs, as some six bytes, and no join meets a key that many rows share.

Keys have 64 bits. At billions of distinct pairs two of them may share a key and then share their counts; a token is
never counted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import count
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import map_batches, split_words, text_crc
from panelforge.storage import durable, release

#: Stands for the end of a text, which also stands before its first word.
END = 0
#: Slices are stored in row groups of this size, so that a reader holds few of them.
GROUP_BYTES = 16 << 20

SLICES = (
    "slice long, doc_id array<long>, lengths binary, train binary, deleted binary, words binary, stream binary, "
    "n_tokens long, n_words long, train_tokens long, kept_tokens long"
)
BLOCKS = "part long, slice long, first long, gaps binary, n binary, d binary"
REPLIES = "part long, slice long, known long, n binary, d binary"
LEFT_OUT = "bucket long, count long, after long, before long, times long"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


class Totals(NamedTuple):
    tokens: int  # of the training text, an end for each text
    kept: int  # the same without the left-out part
    distinct: int


class Slice(NamedTuple):
    """Token by token: the number of its text, of its word and of its pair; the distinct keys of both."""

    rows: np.ndarray
    words: np.ndarray
    pairs: np.ndarray
    word_keys: np.ndarray
    pair_keys: np.ndarray
    train: np.ndarray
    deleted: np.ndarray


def _hashes(distinct: pa.Array) -> np.ndarray:
    values = distinct.cast(pa.binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values), np.uint64, len(values))


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte place by byte place, so that places that hardly vary compress well."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    places = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(places.T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    values = np.zeros((places.shape[1], 8), np.uint8)
    values[:, : data[0]] = places.T
    return values.view("<u8")[:, 0]


def _pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (before << np.uint64(23) | before >> np.uint64(41)) ^ after


def _buckets(counts: np.ndarray) -> np.ndarray:
    """0 for none, else one more than the whole logarithm to base 2."""
    return np.where(counts > 0, np.frexp(np.maximum(counts, 1).astype(float))[1], 0)


def _slice_batches() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    numbers = count(TaskContext.get().partitionId() << 32)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(batch.column("text"), lower=True)
        hashes = np.append(_hashes(words.distinct), np.uint64(END))
        codes = np.insert(words.codes.astype(np.int64), words.ends[1:], len(words.distinct))
        # frequent words get low numbers, which take less room
        order = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lengths = np.diff(words.ends) + 1
        train, deleted = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("train", "deleted"))
        row = {
            "slice": next(numbers), "doc_id": batch.column("doc_id").to_pylist(), "lengths": _pack(lengths),
            "train": _pack(train), "deleted": _pack(deleted), "words": _pack(hashes[order]), "stream": _pack(rank[codes]),
            "n_tokens": len(codes), "n_words": len(hashes), "train_tokens": int(lengths[train].sum()),
            "kept_tokens": int(lengths[train & ~deleted].sum()),
        }
        types = {"doc_id": pa.list_(pa.int64())} | dict.fromkeys(("lengths", "train", "deleted", "words", "stream"), pa.binary())
        return pa.record_batch([pa.array([v], types.get(k, pa.int64())) for k, v in row.items()], list(row))

    return step


def _opened(row: dict) -> Slice:
    lengths, hashes, stream = _unpack(row["lengths"]).astype(np.int64), _unpack(row["words"]), _unpack(row["stream"]).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    after = hashes[stream]
    before = np.roll(after, 1)  # an end stands before the first word of each text, and last of all
    word_keys, place = np.unique(hashes, return_inverse=True)
    pair_keys, pairs = np.unique(_pair_keys(before, after), return_inverse=True)
    flags = (_unpack(row[c]).astype(bool) for c in ("train", "deleted"))
    return Slice(rows, place[stream], pairs, word_keys, pair_keys, *flags)


def _per_slice(function: Callable[[dict], Iterator[pa.RecordBatch]]):
    """Run a function on one stored slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from function(batch.slice(i, 1).to_pylist()[0])
            pa.default_memory_pool().release_unused()

    return run


def _blocks(parts: tuple[int, int], row: dict) -> Iterator[pa.RecordBatch]:
    """The distinct keys of a slice with its counts, in one block per range of keys; words come before pairs."""
    s = _opened(row)
    train, deleted = s.train[s.rows], s.deleted[s.rows]
    for keys, codes, base, ranges in ((s.word_keys, s.words, 0, parts[0]), (s.pair_keys, s.pairs, parts[0], parts[1])):
        n, d = (np.bincount(codes[flag], minlength=len(keys)) for flag in (train, deleted))
        part = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
        made = {name: [] for name in ("part", "slice", "first", "gaps", "n", "d")}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            gaps = np.diff(keys[a:b], prepend=keys[a])
            values = (base + int(part[a]), row["slice"], int(keys[a : a + 1].view(np.int64)[0]), _pack(gaps), _pack(n[a:b]), _pack(d[a:b]))
            for column, value in zip(made.values(), values, strict=True):
                column.append(value)
        types = [pa.int64()] * 3 + [pa.binary()] * 3
        yield pa.record_batch([pa.array(v, t) for v, t in zip(made.values(), types, strict=True)], list(made))


def _merged(blocks: pa.Table) -> pa.Table:
    """Answers to the blocks of one range: the counts of each block's keys over all blocks.

    ``known``, on one of them, is the number of distinct keys of the range in the training text.
    """
    firsts = blocks.column("first").to_numpy().view(np.uint64)
    keys = [first + np.cumsum(_unpack(gaps), dtype=np.uint64) for first, gaps in zip(firsts, blocks.column("gaps").to_pylist(), strict=True)]
    ends = np.cumsum([0, *map(len, keys)])
    distinct, codes = np.unique(np.concatenate(keys), return_inverse=True)
    totals = {}
    for name in ("n", "d"):
        own = np.concatenate([_unpack(b) for b in blocks.column(name).to_pylist()])
        totals[name] = np.bincount(codes, weights=own, minlength=len(distinct)).astype(np.int64)
    known = np.zeros(blocks.num_rows, np.int64)
    known[0] = np.count_nonzero(totals["n"])
    answers = {name: [_pack(total[codes[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)] for name, total in totals.items()}
    columns = [blocks.column("part"), blocks.column("slice"), pa.array(known)] + [pa.array(a, pa.binary()) for a in answers.values()]
    return pa.table(columns, ["part", "slice", "known", "n", "d"])


class Counts(NamedTuple):
    """Counts, over all training texts (``n``) and the left-out ones (``d``), by word and pair of a slice."""

    word_n: np.ndarray
    word_d: np.ndarray
    pair_n: np.ndarray
    pair_d: np.ndarray


def _answered(row: dict, s: Slice) -> Counts:
    n, d = (np.concatenate([_unpack(a[c]) for a in row["answers"]]).astype(np.int64) for c in ("n", "d"))
    cut = len(s.word_keys)
    return Counts(n[:cut], d[:cut], n[cut:], d[cut:])


def _left_out(row: dict) -> Iterator[pa.RecordBatch]:
    """What the weights are learned from: the left-out tokens of a slice, with equal estimates as one row."""
    s = _opened(row)
    c, own = _answered(row, s), s.deleted[s.rows]
    kept = c.word_n - c.word_d
    before, after, both = kept[np.roll(s.words, 1)[own]], kept[s.words[own]], (c.pair_n - c.pair_d)[s.pairs[own]]
    table = pa.table({"bucket": _buckets(before).astype(np.int64), "count": both, "after": after, "before": np.where(both > 0, before, 1)})
    equal = table.group_by(table.column_names).aggregate([([], "count_all")]).rename_columns([*table.column_names, "times"])
    yield from equal.to_batches()


def _scores(weights: np.ndarray, totals: Totals, row: dict) -> Iterator[pa.RecordBatch]:
    """Per text its tokens, the known ones, and both log10 probabilities."""
    s = _opened(row)
    c, texts = _answered(row, s), len(row["doc_id"])
    own, before, both = c.word_n[s.words], c.word_n[np.roll(s.words, 1)], c.pair_n[s.pairs]
    even, one, two = weights[_buckets(before)].T
    even = even + np.where(before > 0, 0, two)
    base = np.log10(own + 1.0) - np.log10(totals.tokens + totals.distinct + 1)
    mixed = even / (totals.distinct + 1) + one * own / max(totals.tokens, 1) + np.where(before > 0, two * both / np.maximum(before, 1), 0)
    columns = [
        pa.array(row["doc_id"], pa.int64()),
        pa.array(np.bincount(s.rows, minlength=texts)),
        pa.array(np.bincount(s.rows[own > 0], minlength=texts)),
        pa.array(np.bincount(s.rows, base, texts)),
        pa.array(np.bincount(s.rows, np.log10(mixed), texts)),
    ]
    yield pa.record_batch(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _stored(df: DataFrame, label: str) -> DataFrame:
    """As ``durable``, in small row groups."""
    return durable(df, label, **{"parquet.block.size": str(GROUP_BYTES)})


def counted_slices(rows: DataFrame, keys_per_part: int, slice_bytes: int) -> tuple[DataFrame, Totals]:
    """The texts of ``rows`` (``doc_id, text, train, deleted``) as slices, each with the counts of its words and pairs.

    A range of keys gets ``keys_per_part`` entries on average, whatever the input: the number of ranges grows with it.
    Keys are hashes, so ranges are even, and a slice has each key once at most. Runs jobs when called.
    """
    made = _stored(map_batches(rows, _slice_batches, SLICES, slice_bytes), "slices")
    sums = made.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "train_tokens", "kept_tokens"))).first()
    parts = tuple(max(1, ceil(sums[c] / keys_per_part)) for c in ("n_words", "n_tokens"))
    blocks = made.mapInArrow(_per_slice(partial(_blocks, parts)), BLOCKS).repartition(sum(parts), "part")
    replies = durable(blocks.groupBy("part").applyInArrow(_merged, REPLIES), "replies")
    distinct = replies.where(F.col("part") < parts[0]).agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    answers = replies.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("part", "n", "d"))).alias("answers"))
    counted = _stored(made.join(answers, "slice"), "counted")
    release(made, replies)
    return counted, Totals(sums["train_tokens"], sums["kept_tokens"], distinct)


def learn_weights(counted: DataFrame, totals: Totals, rounds: int) -> np.ndarray:
    """Weights by bucket (even, unigram, bigram) that make the left-out part most likely: three sums by bucket a round.

    A bucket without left-out tokens keeps even weights; the even estimate always has some weight.
    """
    found = counted.mapInArrow(_per_slice(_left_out), LEFT_OUT).groupBy("bucket", "count", "after", "before")
    shares = [F.lit(1 / (totals.distinct + 1)), F.col("after") / max(totals.kept, 1), F.col("count") / F.col("before")]
    equal = found.agg(F.sum("times").alias("times")).select("bucket", "times", *(x.alias(f"share_{k}") for k, x in enumerate(shares)))
    equal = durable(equal, "left-out")
    weights = np.full((65, 3), 1 / 3)
    weights[0] = (0.5, 0.5, 0.0)
    for _ in range(rounds):
        parts = [F.get(F.array(*map(F.lit, weights[:, k].tolist())), F.col("bucket").cast("int")) * F.col(f"share_{k}") for k in range(3)]
        times = F.col("times") / F.greatest(parts[0] + parts[1] + parts[2], F.lit(1e-300))
        sums = equal.groupBy("bucket").agg(*(F.sum(times * part).alias(f"sum_{k}") for k, part in enumerate(parts)))
        for row in sums.collect():
            mass = np.array(row[1:])
            if mass.sum() > 0:
                weights[row["bucket"]] = mass / mass.sum()
    weights = np.maximum(weights, [1e-6, 0, 0])
    return weights / weights.sum(axis=1, keepdims=True)


def score_by_all_pairs(
    docs: DataFrame,
    held_out: Callable[[Column], Column],
    left_out: Callable[[Column], Column],
    rounds: int = 25,
    keys_per_part: int = 1 << 20,
    slice_bytes: int = 8 << 20,
) -> DataFrame:
    """Learn from the rows that are not held out and score all rows: ``doc_id, n_tokens, n_known, train_tokens,
    base_score, score``. Both choices are made on the checksum of the id as text.

    A word's even share is one of the distinct training tokens and one for all unknown words. A null or empty text
    has its end as its only token. Every row is scored by itself: rows without an id, repeated rows and several texts under one id
    each have a row of the result, and repeated training rows count as often as they are there. Without training rows every score is that
    of unknown words; an empty table gives no rows. Only ``doc_id`` and ``text`` are read. A text longer than
    ``slice_bytes`` is a slice of its own. Neither size changes a result beyond the order of sums. Runs jobs when called.
    """
    crc = text_crc()
    train = ~held_out(crc)
    rows = docs.select(F.col("doc_id").cast("long"), "text", train.alias("train"), (train & left_out(crc)).alias("deleted"))
    counted, totals = counted_slices(rows, keys_per_part, slice_bytes)
    weights = learn_weights(counted, totals, rounds)
    scored = counted.mapInArrow(_per_slice(partial(_scores, weights, totals)), SCORES)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
