"""Fill-in-the-middle: a text cut at two places and put in another order, with marks that tell the parts."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import SMALL_SLICE, map_batches

#: Marks before prefix, suffix and middle. None begins as it or another one ends, so that parts cannot make up a mark.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and so many of these have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: One code point, whatever it is.
CODE_POINT = "(?s:.)"
#: A match keeps some 100 bytes a repetition, so a longer text is matched in stretches of so many repetitions.
STRETCH = 1 << 18


@lru_cache(maxsize=8)
def _patterns(unit: str) -> tuple[regex.Pattern, regex.Pattern]:
    return regex.compile(f"({unit})*+"), regex.compile(f"({unit}){{1,{STRETCH}}}+")


def unit_ends(text: str, unit: str = CODE_POINT) -> np.ndarray:
    """Where each unit of the text ends, in code points: all repetitions that one full match of ``(unit)*`` keeps.

    Beyond ``STRETCH`` code points the text is matched stretch by stretch, for bounded memory; the ends are the same. A text that is no
    repetition of units raises ``ValueError``, and so does a unit that may be empty.
    """
    whole, stretch = _patterns(unit)
    if len(text) <= STRETCH:
        match = whole.fullmatch(text)
        if match is None:
            raise ValueError("the text is not made of units")
        ends = np.array(match.ends(1), np.int64)
    else:
        found, at = [], 0
        while at < len(text):
            match = stretch.match(text, at)
            if match is None or match.end() == at:
                raise ValueError("the text is not made of units")
            found.append(np.array(match.ends(1), np.int64))
            at = match.end()
        ends = np.concatenate(found)
    if len(ends) and np.diff(ends, prepend=0).min() < 1:
        raise ValueError("a unit may not be empty")
    return ends


def arrange(text: str, draws: tuple[int, int, int, int], unit: str = CODE_POINT) -> tuple[int, str, int | None, int | None, str]:
    """``n, form, prefix_chars, middle_chars, output`` of one text from its four draws."""
    ends = unit_ends(text, unit)
    n = len(ends)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or draws[2] % 100 >= CUT_PERCENT:
        return n, "plain", None, None, text
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < SUFFIX_FIRST_PERCENT:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _arranged_batches(unit: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        draws = zip(*(batch.column(f"h{k}").to_pylist() for k in range(1, 5)), strict=True)
        made = list(zip(*(arrange(text, own, unit) for text, own in zip(texts, draws, strict=True)), strict=True))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(values, kind) for values, kind in zip(made, types, strict=True)]
        return pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return step


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = CODE_POINT) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of ``docs``, by its whole text.

    ``n`` units (code points, unless another ``unit`` is given as a pattern) are cut at two places that the seed and ``doc_id`` draw.
    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) or ``plain``, the text as it is: one of ten texts, an empty or
    null one, and one that holds a mark. A null ``doc_id`` draws like an empty one. Repeated rows give equal results, an
    empty table none; columns other than ``doc_id`` and ``text`` are not read. No shuffle.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_batches(rows, partial(_arranged_batches, unit), schema, SMALL_SLICE)


def _between(column: Column, mark: str) -> tuple[Column, Column]:
    return F.substring_index(column, mark, 1), F.substring_index(column, mark, -1)


def restored_text(output: str = "output", form: str = "form") -> Column:
    """The exact text, from output and form alone. Built-in functions only."""
    made = F.col(output)
    marked = F.expr(f"substring(`{output}`, {len(PREFIX) + 1})")
    prefix, rest = _between(marked, SUFFIX)
    suffix, middle = _between(rest, MIDDLE)
    by_prefix = F.concat(prefix, middle, suffix)
    suffix, rest = _between(marked, PREFIX)
    prefix, middle = _between(rest, MIDDLE)
    by_suffix = F.concat(prefix, middle, suffix)
    return F.when(F.col(form) == "psm", by_prefix).when(F.col(form) == "spm", by_suffix).otherwise(made)
