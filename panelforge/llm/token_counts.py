"""Exact byte-level BPE token counts of every prefix of a text.

A text is cut where its pre-tokenizer always cuts, before white space, so that a prefix's tokens are those of
the whole parts before it and of the prefix of one part. Inside a part, dynamic programming over its prefixes
finds the last token of each: the encoding of a prefix is that of a shorter prefix followed by one vocabulary
entry, and exactly one entry fits, the one that no merge ever joins with the token before it. The count is
then one more than that of the shorter prefix.

A text's counts are kept as one signed byte per code point, by which the count changes there. The sum of the
first k is the count of the first k code points, so questions on lengths and budgets need no tokenizer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from panelforge.llm.text import Memo, map_batches

#: The pattern of the byte-level pre-tokenizer, and its form for ASCII text.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: White space of that pattern.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PART = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
RUN = re.compile(f"[{SPACE}]+")
LINE = "\x01"  # stands for a line feed in a text cut at its spaces
#: White space before white space: such a text cannot simply be cut at its spaces and lines.
_BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNEVEN = f"{_BLANK}{_BLANK}|{LINE}"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
PART_MEMO, PIECE_MEMO, PAIR_MEMO = 300_000, 200_000, 500_000
EDGE, UNSET = -1, -2
GAP = "\u0100"  # no byte's letter in the matcher, so no entry spans it


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Counts of all prefixes, from the vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or "(?!)")
        self.rank = {(vocabulary[a], vocabulary[b]): r for r, (a, b) in enumerate(merges)}
        self.made = dict.fromkeys(vocabulary.values(), -1)  # rank of the merge that makes a token; a byte has none
        self.sides = {}
        for r, (a, b) in enumerate(merges):
            token = vocabulary[a + b]
            self.made[token], self.sides[token] = r, (vocabulary[a], vocabulary[b])
        self.matcher = ahocorasick.Automaton()
        for text, token in vocabulary.items():
            if token not in self.sides or self._apart(*self.sides[token], self.made[token]):
                self.matcher.add_word("".join(chr(letters[c]) for c in text), (token, len(text)))
        self.matcher.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces = Memo(self._piece_steps, PIECE_MEMO)
        self.parts = Memo(self._part_steps, PART_MEMO)

    def _apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge of a rank below ``before`` joins the neighbours ``a`` and ``b`` while each is being made.

        Merges are undone from the last on: the later one made of the two goes first, and of equal ones the
        right one, as merges of one rank are done from left to right.
        """
        rank, made, sides = self.rank, self.made, self.sides
        while True:
            joined = rank.get((a, b))
            if joined is not None and joined < before:
                return False
            if made[a] > made[b]:
                before, a = made[a], sides[a][1]
            elif made[b] >= 0:
                before, b = made[b] + 1, sides[b][0]
            else:
                return True

    def _stays(self, before: int, token: int) -> bool:
        """``_apart`` for tokens in turn; the pairs seen are kept."""
        pair = before << 32 | token
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIR_MEMO:
                self.pairs.clear()
            known = self.pairs[pair] = self._apart(before, token)
        return known

    def _piece_steps(self, pieces: list[str]) -> list[bytes]:
        """Of each piece, taken alone, the change of the count at each code point."""
        line = GAP + GAP.join(p.encode().decode("latin-1") for p in pieces) + GAP
        last, count, stays = [EDGE if c == GAP else UNSET for c in line], [0] * len(line), self._stays
        for end, (token, length) in self.matcher.iter(line):
            if last[end] == UNSET:
                before = last[end - length]
                if before == EDGE or stays(before, token):
                    last[end], count[end] = token, count[end - length] + 1
        letters = np.frombuffer(line.encode("utf-16-le"), "<u2")
        inner = (letters & 0xC0 == 0x80) & (letters < 256)  # bytes behind a code point's first
        final = ~np.append(inner[1:], False)
        changes = np.diff(np.array(count)[final])[letters[final][1:] != ord(GAP)]
        steps, ends = _as_steps(changes), np.cumsum([len(p) for p in pieces]).tolist()
        cuts = zip([0, *ends[:-1]], ends, strict=True)
        return [steps[a:b] if len(steps) == len(changes) else _as_steps(changes[a:b]) for a, b in cuts]

    def _part_steps(self, parts: list[str]) -> list[bytes]:
        """The same of parts of a text that start where white space starts, or the text."""
        cut = [(ASCII_PIECE if p.isascii() else PIECE).findall(p) for p in parts]
        plain = ["'" not in p and not RUN.search(p, 1) for p in parts]
        wanted = {piece for pieces, easy in zip(cut, plain, strict=True) if easy for piece in pieces}
        known = dict(zip(wanted, self.pieces.results([*wanted]), strict=True))
        return [
            b"".join(map(known.__getitem__, pieces)) if easy else self._careful_steps(part, pieces)
            for part, pieces, easy in zip(parts, cut, plain, strict=True)
        ]

    def _careful_steps(self, part: str, pieces: list[str]) -> bytes:
        """Steps where a cut changes the piece before it: in a run of white space and in a contraction."""
        runs = {m.start(): m.group() for m in RUN.finditer(part)}
        wanted = list({*pieces, *runs.values(), "'"})
        steps = dict(zip(wanted, map(_as_counts, self.pieces.results(wanted)), strict=True))
        counts, total, at = np.zeros(len(part) + 1, np.int64), 0, 0
        for piece in pieces:
            inside, end = steps[piece], at + len(piece)
            counts[at + 1 : end + 1] = total + inside[1:]
            if piece in LONG_CONTRACTIONS and at + 2 <= len(part):
                counts[at + 2] = total + 2  # the apostrophe and the letter by themselves
            total, at = total + int(inside[-1]), end
        for start, run in runs.items():  # a prefix that ends in a run has the run so far as one piece
            counts[start + 1 : start + 1 + len(run)] = counts[start] + steps[run][1:]
        return _as_steps(np.diff(counts))

    def text_steps(self, text: str) -> bytes:
        """Steps of one text of any form; a special token counts once it is complete."""
        steps, at = [], 0
        for found in self.special.finditer(text):
            opening = self._ordinary_steps(text[at : found.end() - 1])
            counts = changes_of(opening)
            before = int(counts[: found.start() - at].sum(dtype=np.int64))
            steps += [opening, _as_steps(np.array([before + 1 - int(counts.sum(dtype=np.int64))]))]
            at = found.end()
        return b"".join([*steps, self._ordinary_steps(text[at:])])

    def _ordinary_steps(self, text: str) -> bytes:
        parts = PART.findall(text)
        distinct = list(dict.fromkeys(parts))
        known = dict(zip(distinct, self.parts.results(distinct), strict=True))
        return b"".join(map(known.__getitem__, parts))

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The steps of each text of a column, as binary."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, UNEVEN)
        for special in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        odd = odd.to_numpy(zero_copy_only=False)
        even = pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(pc.replace_substring(even, "\n", f" {LINE}"), " ")
        ends, values = lists.offsets.to_numpy().astype(np.int64), lists.values.dictionary_encode()
        heads = lists.values.take(pa.array(ends[:-1])).dictionary_encode()  # a text's first part has no space before it
        parts = [_with_space(p) for p in values.dictionary.to_pylist()]
        bare = [_with_space(p)[1:] if p[:1] != LINE else _with_space(p) for p in heads.dictionary.to_pylist()]
        wanted = list(dict.fromkeys([*parts, *bare]))
        known = dict(zip(wanted, self.parts.results(wanted), strict=True))
        table = [known[p] for p in (*parts, *bare)]
        codes = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes[ends[:-1]] = len(parts) + heads.indices.to_numpy(zero_copy_only=False)
        found = pa.array(table, pa.large_binary()).take(pa.array(codes))
        bounds = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[ends]
        even_steps = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), found.buffers()[2]])
        if not odd.any():
            return even_steps
        slow = [self.text_steps(t) if o else None for t, o in zip(texts.to_pylist(), odd.tolist(), strict=True)]
        return pc.coalesce(pa.array(slow, pa.large_binary()), even_steps)


def _with_space(part: str) -> str:
    return "\n" + part[1:] if part[:1] == LINE else " " + part


#: Stands in the steps for a change that one signed byte cannot hold; the change follows as eight bytes.
WIDE = b"\x80"


def _as_steps(changes: np.ndarray) -> bytes:
    made, at = [], 0
    for i in np.flatnonzero((changes < -127) | (changes > 127)).tolist():
        made += [changes[at:i].astype(np.int8).tobytes(), WIDE, int(changes[i]).to_bytes(8, "little", signed=True)]
        at = i + 1
    return b"".join([*made, changes[at:].astype(np.int8).tobytes()])


def changes_of(steps: bytes) -> np.ndarray:
    """By how much the count changes at each code point."""
    at, wide = 0, steps.find(WIDE)
    if wide < 0:
        return np.frombuffer(steps, np.int8)
    made = []
    while wide >= 0:
        change = int.from_bytes(steps[wide + 1 : wide + 9], "little", signed=True)
        made += [np.frombuffer(steps[at:wide], np.int8), np.array([change])]
        at = wide + 9
        wide = steps.find(WIDE, at)
    return np.concatenate([*made, np.frombuffer(steps[at:], np.int8)])


def _as_counts(steps: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(changes_of(steps), dtype=np.int64)])


prefix_counter = lru_cache(maxsize=1)(PrefixCounter)  # kept by a Python worker from task to task


def _longest(steps: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    within = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def _count_batches(path: str, budget: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    counter = prefix_counter(path)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        found = counter(texts)
        each = [changes_of(s.as_py()) for s in found]
        totals = [int(s.sum(dtype=np.int64)) for s in each]
        fit = [_longest(s, budget) if n > budget else len(s) for s, n in zip(each, totals, strict=True)]
        size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
        columns = [batch.column("doc_id"), size, pa.array(totals, pa.int64()), pa.array(fit, pa.int64()), found.cast(pa.binary())]
        return pa.record_batch(columns, ["doc_id", "n_bytes", "n_tokens", "chars_in_budget", "steps"])

    return step


def prefix_counts(docs: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_tokens, chars_in_budget, steps``, in one pass without a shuffle.

    ``steps`` holds a signed byte per code point (see the module), or nine where a count moves by more than 127; ``chars_in_budget`` answers from it how many
    code points the longest prefix of at most ``budget`` tokens has. A null or empty text has no steps and no
    tokens; repeated rows are counted each; other columns are left out. A special token inside a text is one
    token, as the library's default has it. ``tokenizer`` must be a file that every executor has.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, chars_in_budget long, steps binary"
    return map_batches(docs.select(docs["doc_id"].cast("long"), "text"), partial(_count_batches, tokenizer, budget), schema)


def count_at(steps: bytes, length: int) -> int:
    """Tokens of the first ``length`` code points."""
    return int(changes_of(steps)[:length].sum(dtype=np.int64))


def cut_to(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    return _longest(changes_of(steps), budget)
