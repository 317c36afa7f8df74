"""Benchmark decontamination: random-walk embeddings of item-sized windows, bit sampling, exact edit distance.

Distances count words (A-Z in lower case) inserted, deleted or replaced. A span of a text and an item are a match if the
distance is at most ``max_edits`` of the item's words. The span may be shorter or longer than the item by as many words;
windows of the item's size only serve to meet it.

The embedding reads a sequence with a pointer that, at each of 3n steps, writes the word under it and moves on
or stays, by a random bit of the step and the word. Two sequences with few edits fall into step again after
each, so their embeddings differ in few places: edit distance becomes Hamming distance. A key is a hash of a few
sampled places; an item is compared with the windows that share a key in one of many repetitions, each with bits
and places of its own. Their number is set, on the items themselves, so that a span at the largest distance, of whatever
kind its edits are, is met with the wanted recall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import map_batches, map_rows, split_words
from panelforge.storage import durable, new_path

#: Places of an embedding in a key.
PLACES = 3
#: Symbols of words that no item has, and of places outside a text. Item words count from 2.
OTHER, END = 0, 1
#: Sequences are laid side by side in arrays of about this many places, so that long items need no more memory than short ones.
CELLS = 1 << 20
#: Windows of items with more than twice as many words start at every (words / this)-th place only.
STARTS = 512
#: More repetitions than this are refused.
MOST_REPETITIONS = 4096
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Items:
    """A block of benchmark items, ready to be looked for."""

    ids: np.ndarray  # item ids
    exact: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted hashes of the items that allow no edit, and these items
    texts: list[np.ndarray]  # their symbols
    words: list[str]  # the vocabulary; its entry i is symbol i + 2
    pairs: np.ndarray  # sorted neighbouring symbols of all items
    pairs_of_size: dict[int, np.ndarray]  # by number of words: which pairs items of so many words have
    least_pairs: dict[int, int]  # by number of words: different pairs that a match of any such item has
    keys: np.ndarray  # sorted keys of all items and repetitions
    owners: np.ndarray  # the item of each key
    max_edits: float
    repetitions: int


def most_edits(n: int, max_edits: float) -> int:
    return int(n * max_edits + 1e-9)


def embed_keys(windows: np.ndarray, sizes: np.ndarray, repetitions: int) -> np.ndarray:
    """Keys of windows, one row each, for all repetitions at once. ``sizes`` are the items' words they stand for."""
    count, width = windows.shape
    padded = np.concatenate([windows, np.full((count, 1), END, windows.dtype)], axis=1)
    row = np.arange(count)[:, None]
    repetition = _mix(np.arange(1, repetitions + 1, dtype=np.uint64))[None, :]
    steps = 3 * sizes.astype(np.uint64)[:, None]
    places = [_mix(repetition + np.uint64(1000 + p)) % steps for p in range(PLACES)]
    pointer = np.zeros((count, repetitions), np.int64)
    keys = np.repeat(_mix(sizes.astype(np.uint64))[:, None], repetitions, axis=1) ^ repetition
    for step in range(3 * int(sizes.max())):
        symbol = padded[row, np.minimum(pointer, width)].astype(np.uint64)
        for p, place in enumerate(places):
            taken = _mix(symbol * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * PLACES + p + 1))
            keys = np.where(place == step, keys + taken, keys)
        pointer += (_mix(symbol + repetition * np.uint64(step + 1)) & np.uint64(1)).astype(np.int64)
    return _mix(keys)


def nearest_spans(items: np.ndarray, texts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, start and words of the span of each row of ``texts`` that is nearest to the row of ``items``.

    Of an item the first ``sizes`` symbols count. Of equally near spans the first counts, of those the shortest. ``END`` is
    in no span.
    """
    count, width = len(texts), texts.shape[1] + 1
    across = np.arange(width)
    one = np.int64(width)  # an edit; below it, where the span starts
    line = np.broadcast_to(across, (count, width)).copy()
    result = np.zeros((count, width), np.int64)
    for i in range(items.shape[1]):
        cost = np.where(texts == END, 2, texts != items[:, i : i + 1]) * one
        best = np.concatenate([line[:, :1] + one, np.minimum(line[:, :-1] + cost, line[:, 1:] + one)], axis=1)
        line = np.minimum.accumulate(best - across * one, axis=1) + across * one
        result = np.where(sizes[:, None] == i + 1, line, result)
    stop = result.argmin(axis=1)
    least = result[np.arange(count), stop]
    return least // one, least % one, stop - least % one


def _rows(sequences: list[np.ndarray], width: int) -> np.ndarray:
    rows = np.full((len(sequences), width), END, np.int64)
    for i, s in enumerate(sequences):
        rows[i, : min(len(s), width)] = s[:width]
    return rows


def _edited(text: np.ndarray, kind: str, edits: int, rng: np.random.Generator) -> list[int]:
    """The words of an item after so many edits of a kind."""
    words = text.tolist()
    if kind.startswith("run"):
        at = int(rng.integers(0, len(words) - edits + 1))
        words[at : at + (edits if kind == "run left out" else 0)] = [OTHER] * (edits if kind == "run put in" else 0)
        return words
    for _ in range(edits):
        at = int(rng.integers(0, len(words)))
        one = ("replaced", "left out", "put in")[int(rng.integers(0, 3))] if kind == "mixed" else kind
        words[at : at + (one != "put in")] = [OTHER] * (one != "left out")
    return words


def _alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices in parts of neighbouring sizes, at most 512 of them and about ``CELLS`` places at the part's largest size."""
    order, i = np.argsort(sizes, kind="stable"), 0
    while i < len(order):
        part = order[i : i + 512]
        part = part[: max(1, int(np.searchsorted(sizes[part] * np.arange(1, len(part) + 1), CELLS, "right")))]
        yield part
        i += len(part)


def _all_keys(texts: list[np.ndarray], sizes: np.ndarray, repetitions: int) -> np.ndarray:
    keys = np.empty((len(texts), repetitions), np.uint64)
    for part in _alike(sizes):
        keys[part] = embed_keys(_rows([texts[i] for i in part], int(sizes[part].max())), sizes[part], repetitions)
    return keys


def _stride(n: int) -> int:
    """Windows of ``n`` words start at every so-manieth place."""
    return max(1, n // STARTS)


def _repetitions(texts: list[np.ndarray], max_edits: float, recall: float) -> int:
    """Repetitions after which a span at the largest distance is met with the wanted recall.

    Up to 256 items are edited at random to that distance, by each of several kinds of edits, and set between foreign words.
    The item-sized windows that start, or end, with the edited item stand for it, or those as far before as windows are
    apart. The share of repetitions in which the keys agree is measured for each (none in 128 counts as half of one), and the
    number is the least at which, for every kind, the mean chance of any agreement is high enough. A recall that
    ``MOST_REPETITIONS`` do not reach is refused.
    """
    rng, trial = np.random.default_rng(7), 128
    sample = [texts[i] for i in rng.permutation(len(texts))[:256]]
    sizes = np.array([len(t) for t in sample])
    keys, shares = _all_keys(sample, sizes, trial), []
    for kind in ("replaced", "left out", "put in", "mixed", "run left out", "run put in"):
        first, last = [], []
        for text in sample:
            n, before = len(text), _stride(len(text)) - 1
            edited = np.array(_edited(text, kind, most_edits(n, max_edits), rng), np.int64)
            wide = np.concatenate([np.full(n, OTHER), edited, np.full(n, OTHER)])
            first.append(wide[n - before : 2 * n - before])
            last.append(wide[len(edited) - before : len(edited) + n - before])
        met = [keys == _all_keys(x, sizes, trial) for x in (first, last)]
        shares.append(np.maximum((met[0] | met[1]).mean(axis=1), 0.5 / trial))
    for n in range(8, MOST_REPETITIONS + 1, 8):
        if all(1 - np.mean((1 - share) ** n) >= recall for share in shares):
            return n
    raise ValueError(f"a recall of {recall} at {max_edits} edits a word is not reached by {MOST_REPETITIONS} repetitions")


def _run_hashes(stream: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` symbols."""
    value = np.full(max(len(stream) - n + 1, 0), np.uint64(n))
    for i in range(n):
        value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + stream[i : i + len(value)].astype(np.uint64))
    return value


def prepare(rows: list, max_edits: float = 0.2, recall: float = 0.99) -> Items | None:
    """A block of ``item_id, text`` rows, ready to be looked for.

    Items so short that they allow no edit (below 1 / ``max_edits`` words) are found as equal runs of words, all others by
    their embeddings. Items without an id or a word are left out.
    """
    kept = [(r["item_id"], [w.decode() for w in (r["text"] or "").encode().lower().split()]) for r in rows]
    kept = [(i, words) for i, words in kept if words and i is not None]
    if not kept:
        return None
    words = sorted({w for _, text in kept for w in text})
    number = {w: i + 2 for i, w in enumerate(words)}
    texts = [np.array([number[w] for w in text], np.int64) for _, text in kept]
    sizes = np.array([len(t) for t in texts])
    free = np.array([most_edits(n, max_edits) > 0 for n in sizes.tolist()])
    exact = {}
    for n in np.unique(sizes[~free]).tolist():
        own = np.flatnonzero(~free & (sizes == n))
        hashes = np.array([_run_hashes(texts[i], n)[0] for i in own])
        order = np.argsort(hashes, kind="stable")
        exact[n] = hashes[order], own[order]
    embedded = [t for t, f in zip(texts, free, strict=True) if f]
    pairs = np.unique(np.concatenate([np.empty(0, np.int64), *(t[:-1] << 32 | t[1:] for t in embedded)]))
    pairs_of_size, least_pairs = {}, {}
    for text in embedded:
        distinct = len(np.unique(text[:-1] << 32 | text[1:])) - 2 * most_edits(len(text), max_edits)
        least_pairs[len(text)] = min(distinct, least_pairs.get(len(text), distinct))
        own = pairs_of_size.setdefault(len(text), np.zeros(len(pairs), bool))
        own[np.searchsorted(pairs, text[:-1] << 32 | text[1:])] = True
    repetitions = _repetitions(embedded, max_edits, recall) if embedded else 0
    keys = _all_keys(embedded, sizes[free], repetitions)
    order = np.argsort(keys, axis=None, kind="stable")
    owners = np.repeat(np.flatnonzero(free), repetitions)[order]
    ids = np.array([i for i, _ in kept], np.int64)
    return Items(ids, exact, texts, words, pairs, pairs_of_size, least_pairs, keys.ravel()[order], owners, max_edits, repetitions)


def _spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The integers ``low, low + 1, ...`` of each entry, ``count`` of them, one after the other."""
    return np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


def _windows(stream: np.ndarray, rows: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Texts, starts and sizes of the windows that can match at all; one may begin before its text or end behind it.

    An edit breaks at most two pairs of neighbours, a word put in only one. So a match keeps n - 1 - 2 edits pairs of its
    item of n words, and k more if it is k words longer; a window of n words that cuts k words off loses at most these k.
    A window that has fewer pairs of items of its size is passed over; this loses no match. Only the few
    places that hold a pair of some item are looked at: where the first and last of so many in a row are close
    enough, the windows that cover them all qualify. Of long ones every ``_stride``-th of neighbouring starts stands for all.
    """
    at = np.flatnonzero((stream[:-1] > END) & (stream[1:] > END) & (rows[:-1] == rows[1:]))
    pair = stream[at] << 32 | stream[at + 1]
    place = np.minimum(np.searchsorted(items.pairs, pair), len(items.pairs) - 1)
    same = items.pairs[place] == pair
    at, place = at[same], place[same]
    found = [np.empty((3, 0), np.int64)]
    for n, mine in items.pairs_of_size.items():
        need = max(1, n - 1 - 2 * most_edits(n, items.max_edits))
        hits = at[mine[place]]
        if len(hits) < need:
            continue
        first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
        close = (last - first <= n - 2) & (rows[first] == rows[last])
        apart = rows[first[close]] * 2 * n  # texts are kept apart, as windows may reach beyond them
        low, high = last[close] - (n - 2) + apart, first[close] + apart
        low[1:] = np.maximum(low[1:], high[:-1] + 1)  # both ascend, so each start comes once
        count = np.maximum(high - low + 1, 0)
        start, row = _spread(low, count), np.repeat(rows[first[close]], count)
        if len(start) and _stride(n) > 1:
            head = np.append(True, np.diff(start) > 1)
            run = np.flatnonzero(head)[np.cumsum(head) - 1]
            taken = (np.arange(len(start)) - run) % _stride(n) == 0
            start, row = start[taken], row[taken]
        found.append(np.stack([row, start - row * 2 * n, np.full(len(start), n)]))
    return tuple(np.concatenate(found, axis=1))


def _varied(window: np.ndarray, size: np.ndarray, items: Items) -> np.ndarray:
    """Whether a window has as many different pairs as a match keeps of its item, which repeated words have not."""
    pair = np.sort(window[:, :-1] << 32 | window[:, 1:], axis=1)
    different = 1 + (pair[:, 1:] != pair[:, :-1]).sum(axis=1)
    return different >= np.array([items.least_pairs[n] for n in size.tolist()])


def _cut(stream: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """So many words from each start on, ``END`` where they are outside of the text that lies from ``low`` to ``high``."""
    place = start[:, None] + np.arange(int(size.max()))[None, :]
    cut = stream[np.clip(place, 0, len(stream) - 1)]
    cut[(place < low[:, None]) | (place >= np.minimum(high, start + size)[:, None])] = END
    return cut


def _met(stream: np.ndarray, rows: np.ndarray, begin: np.ndarray, stop: np.ndarray, items: Items) -> np.ndarray:
    """``row, item, start`` of windows that share a key with an item."""
    row, start, size = _windows(stream, rows, items)
    found = [np.empty((0, 3), np.int64)]
    for part in _alike(size):
        r, at, n = row[part], start[part], size[part]
        window = _cut(stream, begin[r], stop[r], at, n)
        varied = _varied(window, n, items)
        if not varied.any():
            continue
        r, at, keys = r[varied], at[varied], embed_keys(window[varied], n[varied], items.repetitions).ravel()
        low, high = np.searchsorted(items.keys, keys, "left"), np.searchsorted(items.keys, keys, "right")
        hit = np.flatnonzero(high > low)
        times = high[hit] - low[hit]
        w, owner = np.repeat(hit // items.repetitions, times), items.owners[_spread(low[hit], times)]
        found.append(np.unique(np.column_stack([r[w], owner, at[w]]), axis=0))
    return np.concatenate(found)


def _near_spans(stream: np.ndarray, rows: np.ndarray, begin: np.ndarray, stop: np.ndarray, items: Items) -> Iterator[np.ndarray]:
    """``row, item, distance, start, size`` of spans within the largest distance, by their embeddings.

    Windows of a text that met the same item and overlap are judged together, so an item's passage is compared once.
    """
    met = _met(stream, rows, begin, stop, items)
    if not len(met):
        return
    lengths = np.array([len(t) for t in items.texts])
    met = met[np.lexsort(met.T[::-1])]
    head = np.ones(len(met), bool)
    head[1:] = (met[1:, :2] != met[:-1, :2]).any(axis=1) | (met[1:, 2] - met[:-1, 2] > lengths[met[1:, 1]])
    of = np.flatnonzero(head)
    row, item, start = met[of].T
    n = lengths[item]
    edits = (n * items.max_edits + 1e-9).astype(np.int64)
    end = np.append(met[of[1:] - 1, 2], met[-1, 2]) + n + edits
    start = np.maximum(start - edits, begin[row])
    end = np.minimum(end, stop[row])
    for part in _alike(end - start):
        i = item[part]
        around = _cut(stream, begin[row[part]], stop[row[part]], start[part], (end - start)[part])
        gaps, at, long = nearest_spans(_rows([items.texts[k] for k in i], int(n[part].max())), around, n[part])
        near = gaps <= edits[part]
        yield np.column_stack([row[part], i, gaps, start[part] + at - begin[row[part]], long])[near]


def _equal_runs(stream: np.ndarray, rows: np.ndarray, begin: np.ndarray, items: Items) -> Iterator[np.ndarray]:
    """The same rows for the items that allow no edit: the first equal run of words in each text."""
    for n, (hashes, own) in items.exact.items():
        runs = _run_hashes(stream, n)
        low, high = np.searchsorted(hashes, runs, "left"), np.searchsorted(hashes, runs, "right")
        at = np.flatnonzero((high > low) & (rows[: len(runs)] == rows[n - 1 :]))
        times = high[at] - low[at]
        place, item = np.repeat(at, times), own[_spread(low[at], times)]
        _, first = np.unique(rows[place] * len(items.texts) + item, return_index=True)
        place, item = place[first], item[first]
        same = np.ones(len(place), bool)
        wanted = np.array([items.texts[i] for i in item], np.int64).reshape(-1, n)
        for k in range(n):
            same &= stream[place + k] == wanted[:, k]
        place, item, row = place[same], item[same], rows[place[same]]
        yield np.column_stack([row, item, np.zeros_like(row), place - begin[row], np.full_like(row, n)])


def _matches(texts: pa.Array, items: Items, vocabulary: pa.Array) -> tuple[np.ndarray, ...]:
    """``row, item, start, size, distance`` of the best span of each text and item that match."""
    words = split_words(texts, lower=True)
    symbol = pc.fill_null(pc.add(pc.index_in(words.distinct, vocabulary), 2), OTHER).to_numpy(zero_copy_only=False)
    stream, rows = symbol.astype(np.int64)[words.codes], words.rows()
    begin, stop = words.ends[:-1], words.ends[1:]
    found = [np.empty((0, 5), np.int64)]
    if len(stream):
        found += _equal_runs(stream, rows, begin, items)
    if len(stream) and len(items.keys):
        found += _near_spans(stream, rows, begin, stop, items)
    every = np.concatenate(found)
    every = every[np.lexsort(every.T[::-1])]  # by row, item, distance, start
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    row, item, gap, start, size = every[first].T
    return row, item, start, size, gap


def _match_batches(items: Items) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    vocabulary = pa.array(items.words)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, item, start, size, gap = _matches(batch.column("text"), items, vocabulary)
        columns = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (items.ids[item], start, size, gap))]
        return pa.record_batch(columns, ["doc_id", "item_id", "start_word", "n_words", "distance"])

    return step


def _clean_batches(items: Items) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    vocabulary = pa.array(items.words)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = _matches(batch.column("text"), items, vocabulary)[0]
        kept = np.ones(batch.num_rows, bool)
        kept[row] = False
        return batch.filter(pa.array(kept))

    return step


def item_blocks(benchmark: DataFrame, block_items: int, block_bytes: int, **options) -> Iterator[Items]:
    """The benchmark in blocks of at most ``block_items`` items and about ``block_bytes`` bytes, made one at a time.

    Rows that repeat an id and text count once; a null text has no words. Runs a job when the first is asked for, and the
    driver holds one block and one part of the sorted benchmark.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), "text").distinct()
    block, held = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        size = len(row["text"] or "")
        if block and (len(block) >= block_items or held + size > block_bytes):
            ready = prepare(block, **options)
            if ready:
                yield ready
            block, held = [], 0
        block.append(row)
        held += size
    ready = prepare(block, **options)
    if ready:
        yield ready


def contaminations(
    docs: DataFrame, benchmark: DataFrame, block_items: int = 5000, block_bytes: int = 8 << 20, **options
) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, distance`` of the nearest span, per row of ``docs`` and item in it.

    One pass over the texts per block of items, without a shuffle; its matches are stored before the next block is made. Of
    equally near spans the first counts. Items that allow no edit are met where their words stand in a row. Items of any
    length are looked for; a long one in a text costs its words times those of its passage. A null or empty text matches
    nothing; repeated rows are each reported; an empty table, or a benchmark without words, gives no rows. ``options`` are
    those of ``prepare``: ``max_edits`` (0.2) and ``recall`` (0.99), which raises an error where it can't be reached.
    """
    spark, narrow = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    path = new_path(spark, "matches")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    for items in item_blocks(benchmark, block_items, block_bytes, **options):
        map_batches(narrow, partial(_match_batches, items), SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, block_items: int = 5000, block_bytes: int = 8 << 20, **options
) -> DataFrame:
    """The rows of ``docs`` in which ``contaminations`` finds nothing, with all their columns, in the same passes.

    What a block leaves is stored for the next one; after the last block nothing is. So the driver holds two blocks at most.
    """
    blocks = item_blocks(benchmark, block_items, block_bytes, **options)
    ready = next(blocks, None)
    while ready:
        following = next(blocks, None)
        docs = map_rows(docs, partial(_clean_batches, ready))
        docs = durable(docs, "uncontaminated") if following else docs
        ready = following
    return docs
