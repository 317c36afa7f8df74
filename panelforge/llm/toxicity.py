"""Toxicity scores from a convolutional network over hashed word embeddings, with thresholds by language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import SMALL_SLICE, Words, give_back, map_batches, map_rows, split_words, text_crc
from panelforge.storage import clustered, durable, release, settings

#: A word's vector is the sum of hashed vectors: of the word, and of its beginnings of so many bytes.
BEGINNINGS = (4, 5, 6, 7)
BUCKETS = 1 << 18
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
#: The score that stands for a text at its language's threshold.
CUT = 0.7
#: Rows of each label in a step of the training.
STEP_ROWS = 16
#: Trained vectors come back from a shard in pieces of so many buckets.
PIECE = 1024
#: Log odds are counted by steps of one in so many, which the thresholds lie between.
GRID = 1024
PIECES = "shard long, name string, piece long, moved binary, value binary, seen binary"
#: Settings of Spark under which a join filters its larger side by a Bloom filter of the other's keys before any shuffle,
#: whatever the sizes of the tables.
BLOOM = "spark.sql.optimizer.runtime.bloomFilter"
PRUNED = {"spark.sql.autoBroadcastJoinThreshold": -1, f"{BLOOM}.enabled": True, f"{BLOOM}.applicationSideScanSizeThreshold": 0, f"{BLOOM}.creationSideThreshold": "1t"}
#: Buckets of the dealt rows for each shard, so that few shards share one and with it a task.
SHARD_BUCKETS = 4
#: Words that tell the language of a text; a text with none, or as many of two languages, is of the last, unnamed one.
LANGUAGE_WORDS = {
    "en": "the of and to is that it for was with".split(),
    "de": "der die und das nicht ist ein mit sich von".split(),
    "fr": "les des est pour qui dans une et au sur".split(),
    "es": "el los en las por con una del y para".split(),
}


@dataclass(frozen=True)
class Network:
    """Vectors of the buckets that were trained, filters by width, output weights, and a threshold by language."""

    buckets: np.ndarray
    vectors: np.ndarray
    filters: tuple[np.ndarray, ...]
    biases: np.ndarray
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray


def word_buckets(words: pa.Array) -> np.ndarray:
    """Buckets of each word, one row a word: of the word, and of each beginning, ``BUCKETS`` where it is shorter.

    Hashes are differences of one running sum over the bytes of all words, so there is no step per word.
    """
    words = words.cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64)
    starts, sizes = bounds[:-1] - bounds[0], np.diff(bounds)
    powers = np.full(int(sizes.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers)  # wraps around, as a hash may
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * powers[place])])
    found = np.empty((len(words), 1 + len(BEGINNINGS)), np.int64)
    for k, length in enumerate((None, *BEGINNINGS)):
        size = sizes if length is None else np.minimum(sizes, length)
        mixed = sums[starts + size] - sums[starts] + size.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        bucket = ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)
        found[:, k] = bucket if length is None else np.where(sizes > length, bucket, BUCKETS)
    return found


@dataclass(frozen=True)
class Layout:
    """Word numbers of some texts one after the other, each followed by ``pad`` numbers that stand for no word.

    A filter may start at the places ``first``; those of text i begin at ``bounds[i]``. A text without words has one.
    """

    codes: np.ndarray
    first: np.ndarray
    bounds: np.ndarray


def lay_out(codes: np.ndarray, ends: np.ndarray, none: int) -> Layout:
    pad = max(WIDTHS)  # an empty text's one place reads nothing else
    sizes = np.diff(ends)
    shift = np.repeat(np.arange(len(sizes)) * pad, sizes)
    laid = np.full(len(codes) + pad * len(sizes), none, np.int64)
    laid[np.arange(len(codes)) + shift] = codes
    places = np.maximum(sizes, 1)
    bounds = np.cumsum(places) - places
    begins = ends[:-1] - ends[0] + np.arange(len(sizes)) * pad
    first = np.arange(places.sum()) + np.repeat(begins - bounds, places)
    return Layout(laid, first, bounds)


def _responses(layout: Layout, vectors: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """What each filter of one width answers at each place. ``vectors`` has a last row of zeros for no word."""
    answer = 0
    for offset, matrix in enumerate(kernel):
        answer = answer + (vectors @ matrix)[layout.codes[layout.first + offset]]
    return answer


def _pooled(layout: Layout, vectors: np.ndarray, filters: tuple[np.ndarray, ...]) -> np.ndarray:
    """The greatest answer of each filter in each text."""
    return np.hstack([np.maximum.reduceat(_responses(layout, vectors, kernel), layout.bounds, axis=0) for kernel in filters])


@dataclass
class Training:
    """A network in training: its arrays by name, and for each the squared gradients that Adagrad has seen."""

    values: dict[str, np.ndarray]
    seen: dict[str, np.ndarray]

    def step(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.seen[name][rows] += gradient**2
        rate = 0.15 if name == "vectors" else 0.05
        self.values[name][rows] -= rate * gradient / np.sqrt(self.seen[name][rows])

    def network(self, used: np.ndarray, thresholds: np.ndarray) -> Network:
        v = self.values
        filters = tuple(v[f"filter_{w}"] for w in WIDTHS)
        return Network(used, v["vectors"][:-1], filters, v["biases"], v["weights"], float(v["bias"][0]), thresholds)


def untrained(used: int, seed: int = 7) -> Training:
    """Random vectors for ``used`` buckets and a last one of zeros for no word, random filters and weights."""
    rng, n = np.random.default_rng(seed), len(WIDTHS) * FILTERS
    values = {"vectors": np.vstack([rng.normal(0, 0.1, (used, DIM)), np.zeros((1, DIM))]).astype(np.float32)}
    values |= {f"filter_{w}": rng.normal(0, (DIM * w) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    values |= {"biases": np.zeros(n, np.float32), "weights": rng.normal(0, 0.3, n).astype(np.float32), "bias": np.zeros(1, np.float32)}
    return Training(values, {name: np.full(value.shape, 1e-3, np.float32) for name, value in values.items()})


def _turns(rng: np.random.Generator, own: np.ndarray, steps: int) -> np.ndarray:
    """The rows of one label that each step takes: all of them in a random order, again and again."""
    if not len(own):
        return np.empty((steps, 0), np.int64)
    times = ceil(steps * STEP_ROWS / len(own))
    return np.concatenate([rng.permutation(own) for _ in range(times)])[: steps * STEP_ROWS].reshape(steps, STEP_ROWS)


def train(state: Training, rows: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, least_steps: int, seed: tuple[int, ...]) -> None:
    """Train ``state`` on texts given as word numbers; ``rows`` holds the vectors of each word, the last one for none.

    A step takes ``STEP_ROWS`` texts of each label. There are as many steps as every text needs to be taken, and
    ``least_steps`` at least. In each, half of the words lose the vector of the whole word, so that beginnings are learned too, and a
    tenth of the words are left out. Seeded: reruns agree.
    """
    rng = np.random.default_rng(seed)
    by_label = [np.flatnonzero(labels == label) for label in (0, 1)]
    steps = max(least_steps, *(ceil(len(own) / STEP_ROWS) for own in by_label))
    turns = np.hstack([_turns(rng, own, steps) for own in by_label])
    vectors, filters = state.values["vectors"], [state.values[f"filter_{w}"] for w in WIDTHS]
    biases, weights, bias = (state.values[name] for name in ("biases", "weights", "bias"))
    none = len(vectors) - 1
    for chosen in turns:
        ends = np.concatenate([[0], np.cumsum([len(texts[i]) for i in chosen])])
        words, codes = np.unique(np.concatenate([texts[i] for i in chosen]), return_inverse=True)
        parts = rows[words]
        parts[rng.random(len(words)) < 0.5, 0] = none
        parts[rng.random(len(words)) < 0.1] = none
        table = np.vstack([vectors[parts].sum(1), np.zeros((1, DIM), np.float32)])
        layout = lay_out(codes, ends, len(words))
        stops = np.append(layout.bounds[1:], len(layout.first))
        tops, places = [], []
        for kernel in filters:
            answer = _responses(layout, table, kernel)
            at = np.array([a + answer[a:b].argmax(0) for a, b in zip(layout.bounds, stops, strict=True)])
            tops.append(np.take_along_axis(answer, at, 0))
            places.append(layout.first[at])
        raw = np.hstack(tops) + biases
        hidden = np.maximum(raw, 0)
        miss = ((1 / (1 + np.exp(-np.clip(hidden @ weights + bias, -30, 30)))) - labels[chosen]).astype(np.float32) / len(chosen)
        back = np.outer(miss, weights) * (raw > 0)
        state.step("weights", hidden.T @ miss + 1e-4 * weights)
        state.step("bias", miss.sum(keepdims=True))
        state.step("biases", back.sum(0))
        of_words = np.zeros_like(table)
        for k, (w, kernel) in enumerate(zip(WIDTHS, filters, strict=True)):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            change = np.empty_like(kernel)
            for offset in range(w):
                at = layout.codes[places[k] + offset]
                change[offset] = np.einsum("bfd,bf->df", table[at], own)
                np.add.at(of_words, at, own[:, :, None] * kernel[offset].T[None])
            state.step(f"filter_{w}", change + 1e-4 * kernel)
        moved = np.flatnonzero(np.abs(of_words[:-1]).sum(1))
        at, inverse = np.unique(parts[moved], return_inverse=True)
        change = np.zeros((len(at), DIM), np.float32)
        np.add.at(change, inverse.reshape(len(moved), -1), of_words[moved][:, None, :])
        real = at < none
        state.step("vectors", change[real], at[real])


def log_odds(words: Words, model: Network) -> np.ndarray:
    """The network's output for each text, by whole texts."""
    buckets = word_buckets(words.distinct)
    number = _numbers(model.buckets)
    known = np.vstack([model.vectors, np.zeros((1, DIM), np.float32)])
    table = np.vstack([known[number[buckets]].sum(1), np.zeros((1, DIM), np.float32)])
    layout = lay_out(words.codes, words.ends, len(words.distinct))
    hidden = np.maximum(_pooled(layout, table, model.filters) + model.biases, 0)
    return hidden.astype(float) @ model.weights.astype(float) + model.bias


def language_of(words: Words) -> np.ndarray:
    """The number of each text's language, told by its own words."""
    found = np.zeros((len(words.ends) - 1, len(LANGUAGE_WORDS)), np.int64)
    for k, own in enumerate(LANGUAGE_WORDS.values()):
        member = np.append(pc.is_in(words.distinct, pa.array(own)).to_numpy(zero_copy_only=False), False)
        running = np.concatenate([[0], np.cumsum(member[words.codes])])
        found[:, k] = np.diff(running[words.ends])
    most = found.max(1, initial=0)
    clear = (found == most[:, None]).sum(1) == 1
    return np.where(clear, found.argmax(1), len(LANGUAGE_WORDS))


def words_of(texts: pa.Array) -> Words:
    """Words in lower case; null has none."""
    return split_words(pc.utf8_lower(pc.fill_null(texts, "")))


def thresholds(values: np.ndarray, labels: np.ndarray, languages: np.ndarray, times: np.ndarray, pseudo: float = 20.0) -> np.ndarray:
    """A limit by language (the last one for all others) that makes the fewest errors.

    A language's errors count with those of all rows, brought to ``pseudo`` rows, so a language with few rows keeps near
    the common limit. Of equal limits the one in the widest gap between two values is taken.
    """
    limits = np.zeros(len(LANGUAGE_WORDS) + 1)
    if not len(values):
        return limits
    order = np.argsort(values, kind="stable")
    values, labels, languages, times = values[order], labels[order], languages[order], times[order]
    edges = np.concatenate([[values[0] - 4], values, [values[-1] + 4]])
    apart = np.diff(edges) > 0  # no limit lies between equal values
    for k in range(len(limits)):
        cost = times * ((languages == k) + pseudo / times.sum())
        missed = np.concatenate([[0], np.cumsum(cost * (labels == 1))])
        wrong = np.concatenate([np.cumsum((cost * (labels == 0))[::-1])[::-1], [0]])
        total = np.where(apart, missed + wrong, np.inf)
        gaps = np.where(total <= total.min() + 1e-9, np.diff(edges), -1)
        i = int(gaps.argmax())
        limits[k] = (edges[i] + edges[i + 1]) / 2
    return limits


def _numbers(used: np.ndarray) -> np.ndarray:
    """Of each bucket the number of its vector; the last number stands for none."""
    number = np.full(BUCKETS + 1, len(used), np.int64)
    number[used] = np.arange(len(used))
    return number


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``order, label, text`` of all rows to learn from, stored. Of several labels the highest counts; null ones do not.

    The labels are stored first, and the join drops documents that a Bloom filter of their ids rules out before it shuffles
    texts. So the disk it takes follows the labelled texts, and the plan is the same at all sizes.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (text_crc() % 3 != 1))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("marked")).agg(F.max("toxic").cast("int").alias("label"))
    marks = durable(marks, "toxic-marks")
    ids = max(marks.count(), 1024)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # Catalyst makes the filter only from a side that has a condition itself.
    met = rows.join(marks.where(F.col("label").isin(0, 1)), F.col("doc_id") == F.col("marked"))
    with settings(docs.sparkSession, PRUNED | {f"{BLOOM}.expectedNumItems": ids, f"{BLOOM}.numBits": 16 * ids}):
        found = durable(met.select(F.xxhash64("marked").alias("order"), "label", "text"), "toxic-rows")
    release(marks)
    return found


def _bucket_batches() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(batch.column("text"))
        pairs = np.unique(np.stack([words.rows(), words.codes]), axis=1) if len(words.codes) else np.empty((2, 0), np.int64)
        met = word_buckets(words.distinct)[pairs[1]]
        met = np.unique(pairs[0][:, None] * (BUCKETS + 1) + met) % (BUCKETS + 1)
        n = np.bincount(met, minlength=BUCKETS + 1)[:BUCKETS]
        found = np.flatnonzero(n)
        return pa.record_batch([pa.array(found), pa.array(n[found])], ["bucket", "n"])

    return step


def known_buckets(rows: DataFrame, least_texts: int = 3) -> np.ndarray:
    """Buckets met in at least ``least_texts`` of all texts of ``rows``, so that no text is learned by a word of its own."""
    counts = map_batches(rows.select("text"), _bucket_batches, "bucket long, n long", SMALL_SLICE)
    known = durable(counts.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least_texts).select("bucket"), "toxic-buckets")
    return np.sort(known.toArrow()["bucket"].to_numpy())


def _coded(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts as word numbers, and the buckets of each word; few texts are split at a time."""
    spans, distinct, at = [], [], 0
    for a in range(0, len(texts), 1024):
        words = words_of(texts[a : a + 1024])
        codes = words.codes.astype(np.int64) + at
        spans += [codes[x:y].astype(np.int32) for x, y in zip(words.ends[:-1], words.ends[1:], strict=True)]
        distinct.append(words.distinct)
        at += len(words.distinct)
    both = pa.concat_arrays(distinct).dictionary_encode()
    place = both.indices.to_numpy(zero_copy_only=False)
    return [place[codes] for codes in spans], word_buckets(both.dictionary)


def _pieces(state: Training, before: Training, shard: int) -> pa.Table:
    """What training made of each array, piece by piece, with the rows that it changed."""
    made = {name: [] for name in ("shard", "name", "piece", "moved", "value", "seen")}
    for name, value in state.values.items():
        size = PIECE if name == "vectors" else max(len(value), 1)
        for piece, a in enumerate(range(0, len(value), size)):
            seen = state.seen[name][a : a + size]
            moved = (seen != before.seen[name][a : a + size]).reshape(len(seen), -1).any(1)
            row = (shard, name, piece, moved.tobytes(), value[a : a + size][moved].tobytes(), seen[moved].tobytes())
            for column, own in zip(made.values(), row, strict=True):
                column.append(own)
    types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(v, t) for v, t in zip(made.values(), types, strict=True)], list(made))


def _train_shard(before: Training, used: np.ndarray, least_steps: int, turn: int, table: pa.Table) -> pa.Table:
    keys = table.append_column("bytes", pc.binary_length(table["text"]))
    table = table.take(pc.sort_indices(keys, [(c, "ascending") for c in ("order", "label", "bytes", "text")]))
    shard = table["shard"][0].as_py()
    spans, buckets = _coded(table["text"].combine_chunks())
    state = Training({k: v.copy() for k, v in before.values.items()}, {k: v.copy() for k, v in before.seen.items()})
    labels = table["label"].to_numpy().astype(np.float32)
    train(state, _numbers(used)[buckets], spans, labels, least_steps, (7, turn, shard))
    made = _pieces(state, before, shard)
    del table, keys, spans, buckets, state
    give_back()
    return made


def _mean_piece(table: pa.Table) -> pa.Table:
    """The mean of a piece over the shards, row by row over those that changed the row."""
    rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
    moved = [np.frombuffer(r["moved"], bool) for r in rows]
    times, sums = np.sum(moved, axis=0), {}
    for name in ("value", "seen"):
        for r, own in zip(rows, moved, strict=True):
            if own.any():
                values = np.frombuffer(r[name], np.float32).reshape(own.sum(), -1).astype(float)
                sums.setdefault(name, np.zeros((len(own), values.shape[1])))[own] += values
    one = {name: (total[times > 0] / times[times > 0, None]).astype(np.float32).tobytes() for name, total in sums.items()}
    row = {"shard": -1, "name": rows[0]["name"], "piece": rows[0]["piece"], "moved": (times > 0).tobytes()}
    return pa.Table.from_pylist([row | {"value": one.get("value", b""), "seen": one.get("seen", b"")}], table.schema)


def _trained(state: Training, rows: DataFrame, used: np.ndarray, least_steps: int, turn: int) -> Training:
    """``state`` trained by every shard of ``rows`` by itself, and the mean of what they made of it."""

    def train_shard(table: pa.Table) -> pa.Table:
        return _train_shard(state, used, least_steps, turn, table)

    pieces = rows.groupBy("shard").applyInArrow(train_shard, PIECES)
    means = durable(pieces.groupBy("name", "piece").applyInArrow(_mean_piece, PIECES), "toxic-pieces")
    after = Training({k: v.copy() for k, v in state.values.items()}, {k: v.copy() for k, v in state.seen.items()})
    for row in means.toArrow().to_pylist():
        moved = np.frombuffer(row["moved"], bool)
        for arrays, column in ((after.values, "value"), (after.seen, "seen")):
            own = arrays[row["name"]][row["piece"] * PIECE :][: len(moved)]
            own[moved] = np.frombuffer(row[column], np.float32).reshape(own[moved].shape)
    release(means)
    return after


def _odds_batches(model: Network) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(batch.column("text"))
        place = np.floor(np.clip(log_odds(words, model), -1000, 1000) * GRID).astype(np.int64)
        return pa.record_batch([pa.array(place), pa.array(language_of(words)), batch.column("label")], ["place", "language", "label"])

    return step


def _limits(rows: DataFrame, model: Network) -> np.ndarray:
    """The thresholds that all of ``rows`` ask for: they are counted by ``GRID`` places, language and label."""
    placed = map_batches(rows.select("text", "label"), partial(_odds_batches, model), "place long, language long, label int", SMALL_SLICE)
    counts = durable(placed.groupBy("place", "language", "label").agg(F.count("*").alias("n")), "toxic-places").toArrow()
    counts = counts.sort_by([(c, "ascending") for c in ("place", "language", "label")])
    place, language, label, n = (counts[c].to_numpy() for c in ("place", "language", "label", "n"))
    return thresholds((place + 0.5) / GRID, label, language, n.astype(float))


def fit(
    docs: DataFrame, labels: DataFrame, steps: int = 1600, shard_rows: int = 16384, shard_bytes: int = 32 << 20, rounds: int = 2
) -> Network | None:
    """Learn from all labelled rows that are not held out; null if a class has none. Runs jobs when called.

    No row is left out: three in four, by a hash, train the network, and all others set the thresholds, whatever
    the length of their texts. The rows to train on are dealt to shards of about ``shard_rows`` rows and
    ``shard_bytes``. One shard trains the first network, with ``steps`` steps at least and all of its rows. Where there
    are more, ``rounds`` times every shard trains on from the same network with all of its rows, by itself, and
    the mean of what they made is the next one. A class with few rows goes to every shard whole. So a task holds one shard, the
    driver one network. Reruns agree. Where a class has no row to spare for the thresholds, the training rows set them.
    """
    rows = _labelled(docs, labels)
    spare = F.pmod("order", F.lit(4)) == 0
    sums = rows.groupBy("label", spare.alias("spare")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    classes = {flag: {r["label"] for r in sums if r["spare"] == flag} for flag in (False, True)}
    if len(classes[False] | classes[True]) < 2:
        return None
    split = len(classes[False]) == 2
    trains = rows.where(~spare) if split else rows
    own = [r for r in sums if not (split and r["spare"])]
    shards = max(1, ceil(sum(r["n"] for r in own) / shard_rows), ceil(sum(r["bytes"] for r in own) / shard_bytes))
    rare = [label for label in (0, 1) if sum(r["n"] for r in own if r["label"] == label) < 2 * STEP_ROWS * shards]
    one = F.array(F.pmod(F.xxhash64("order", "text"), F.lit(shards)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    dealt = trains.withColumn("shard", F.explode(F.when(F.col("label").isin(rare), every).otherwise(one)))
    used = known_buckets(trains)
    with clustered(dealt.select("shard", "order", "label", "text"), "toxic-shards", "shard", SHARD_BUCKETS * shards) as stored:
        state = _trained(untrained(len(used)), stored.where("shard = 0"), used, steps, 0)
        for turn in range(1, 1 + rounds * (shards > 1)):
            state = _trained(state, stored, used, 1, turn)
    model = state.network(used, np.zeros(len(LANGUAGE_WORDS) + 1))
    limits = _limits(rows.where(spare) if split and len(classes[True]) == 2 else trains, model)
    release(rows)
    return state.network(used, limits)


def _score_batches(model: Network, name: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    named = pa.array([*LANGUAGE_WORDS, None])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(batch.column("text"))
        language = language_of(words)
        odds = log_odds(words, model) - model.thresholds[language] + np.log(CUT / (1 - CUT))
        score = pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        columns = [*(batch.column(c) for c in batch.schema.names), named.take(pa.array(language)), score]
        return pa.record_batch(columns, [*batch.schema.names, f"{name}_language", name])

    return step


def score(rows: DataFrame, model: Network | None, name: str = "toxic_score") -> DataFrame:
    """``rows`` (with a ``text``), the language that their words tell as ``<name>_language``, and a score from 0 to 1 as ``name``.

    The text is the only input; the score is ``CUT`` at the threshold of the text's language. The whole text is read, whatever its
    length. A null or empty text gets the score of a text without known words; repeated rows get equal scores; an empty
    table gives no rows; other columns stay as they are, so neither name may be one of them. Without a model, where
    a class had no labelled row, every score is 0.5 and the language is null.
    """
    if {name, f"{name}_language"} & set(rows.columns):
        raise ValueError(f"the rows have a column {name} or {name}_language already")
    if model is None:
        return rows.withColumns({f"{name}_language": F.lit(None).cast("string"), name: F.lit(0.5)})
    return map_rows(rows, partial(_score_batches, model, name), f"{name}_language string", f"{name} double")
