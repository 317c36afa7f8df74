"""What the text operators share: words of Arrow batches, and a memo of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Words longer than this are looked up anew each time, so that a memo's memory is bounded.
MEMO_LENGTH = 64
#: Texts are worked on in pieces of a batch of about this many bytes, so that a worker's memory is bounded.
SLICE_BYTES = 16 << 20
#: The same for functions that hold much more than the text.
SMALL_SLICE = 4 << 20


class Words(NamedTuple):
    """The words of some texts: ``codes`` number the entries of ``distinct``; text i has those from ``ends[i]`` on."""

    codes: np.ndarray
    distinct: pa.Array
    ends: np.ndarray

    def rows(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of a string column; null has none. ``lower`` puts A-Z, and no other letter, in lower case.

    Arrow's ASCII white space is exactly the six characters that ``WORD`` leaves out.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    values, bounds = lists.values, lists.offsets.to_numpy().astype(np.int64)
    filled = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    kept = np.concatenate([[0], np.cumsum(filled)])
    encoded = (values if filled.all() else values.filter(pa.array(filled))).dictionary_encode()
    return Words(encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary, kept[bounds])


def slices(batch: pa.RecordBatch, column: str, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``slice_bytes``; a longer text is a piece of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size, dtype=np.int64) // slice_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Return memory to the system that neither Arrow nor Python's allocator needs any more."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Run one function per slice of each Arrow batch. ``make`` is called once per task and keeps the task's state.

    Workers outlive tasks, so unused memory is given back after each batch, and once more when the task's state is gone.
    """
    column = "text" if "text" in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for piece in slices(batch, column, slice_bytes) if column else [batch]:
                if piece.num_rows:
                    yield step(piece)
            give_back()
        step = batch = piece = None
        give_back()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], *added: str) -> DataFrame:
    """``map_batches`` over rows that keep all their columns, whatever their names, and get those ``added``
    (``"name type"``). The function sees the text as ``text`` and the others under plain names."""
    plain = df.toDF(*("text" if c == "text" else f"c{i}" for i, c in enumerate(df.columns)))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema]
    found = map_batches(plain, make, ", ".join([*kept, *added]), SMALL_SLICE)
    return found.toDF(*df.columns, *(a.split(" ")[0] for a in added))


def text_crc(column: str = "doc_id") -> Column:
    """Checksum of a column as text, by which rows are held out; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


class Memo:
    """Results of a function by key in two generations: when the young one is full it becomes the old one.

    About ``2 * size`` results are held, whatever the text; which ones are held never changes a result. The
    function gets all new keys of a call at once and returns their results in order.
    """

    def __init__(self, function: Callable[[list], list], size: int):
        self.function, self.size, self.young, self.old = function, size, {}, {}

    def results(self, keys: list) -> list:
        """One result per key; the keys are distinct."""
        young, old = self.young, self.old
        found = [young.get(k) if k in young else old.get(k) for k in keys]
        new = [k for k, value in zip(keys, found, strict=True) if value is None]
        if new:
            made = iter(self.function(new))
            found = [next(made) if value is None else value for value in found]
        young.update((k, value) for k, value in zip(keys, found, strict=True) if len(k) <= MEMO_LENGTH)
        if len(young) >= self.size:
            self.old, self.young = young, {}
        return found
