"""Operators where there is little or very much of something: rows of a language, matches of a text, a step of a count."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import divergence, queries, secret_links, token_counts
from tests.llm import brute

WORDS = {
    "en": "the of and to in is that it for on was with house river garden market window letter morning winter people".split(),
    "de": "der die und das den von zu mit sich auf haus fluss garten markt fenster brief morgen winter leute nicht".split(),
    "ru": "и в не на что он как это по но дом река сад рынок окно письмо утро зима люди город".split(),
}


def speech(rng, lang, n=120):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def judged(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"]: r["kept"] for r in divergence.judge_quality(docs).collect()}


@pytest.mark.parametrize("few", [1, 2, 99, 100, 101])
def test_a_small_language_is_judged_as_a_large_one(spark, few):
    rng = random.Random(few)
    rows = [(i, speech(rng, "en"), "en") for i in range(400)]
    rows += [(1000 + i, speech(rng, "ru"), "ru") for i in range(few)] + [(5000, speech(rng, "ru"), None)]
    kept = judged(spark, rows)
    assert all(kept[d] for d, *_ in rows)


def test_wrong_languages_and_word_salad_are_far(spark):
    rng = random.Random(8)
    rows = [(i, speech(rng, lang), lang) for i, lang in enumerate(["en", "de"] * 300)]
    wrong = [(1000 + i, speech(rng, "de"), "en") for i in range(30)] + [(2000 + i, speech(rng, "en"), "de") for i in range(30)]
    salad = [(3000 + i, " ".join(rng.choice(WORDS["en"][12:]) for _ in range(120)), "en") for i in range(30)]
    kept = judged(spark, rows + wrong + salad)
    assert sum(kept[d] for d, *_ in rows) >= 0.99 * len(rows)
    assert sum(kept[d] for d, *_ in wrong + salad) <= 0.1 * len(wrong + salad)


def test_time_grows_with_the_matches_of_a_text(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "password=abcdefghijklmnop " * n)], "doc_id long, text string")
        begin = time.perf_counter()
        row = secret_links.find_secrets(docs).first()
        took = time.perf_counter() - begin
        assert [tuple(s)[1:3] for s in row["assign"]] == [(26 * i, 26 * i + 25) for i in range(n)]
        return took

    seconds(1000)
    small, large = seconds(32_000), seconds(64_000)
    assert large < 3 * small + 1


IDENT = re.compile(r"""((?i:access_?key_?id|client_?id|user_?name|user|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]+)""")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40,}={0,2}")
ENDPOINT = re.compile(r"""https?://[^\x20\x09-\x0D"'<>]+""")


def linked_spans(text, scope=200):
    """All spans of a text, weak ones where their complements are near, by the definition."""
    spans = [(m.start(), m.end(), "ident", "identifier") for m in IDENT.finditer(text) if len(m[2]) >= 3]
    spans += [(m.start(), m.end(), "access", "identifier") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    for m in brute.ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            spans.append((m.start(), m.end(), "assign" if len(m[2]) >= 12 else "weak", "secret"))
    spans += [(m.start(), m.end(), "weak", "secret") for m in TOKEN.finditer(text)]
    spans += [(m.start(), m.end(), "endpoint", "endpoint") for m in ENDPOINT.finditer(text)]
    found = set()
    for a, b, kind, role in spans:
        near = {r for c, e, _, r in spans if r != role and c <= b + scope and a <= e + scope}
        wanted = {"identifier": {"secret"}, "secret": {"identifier"}, "endpoint": {"identifier", "secret"}}[role]
        if kind in ("ident", "weak", "endpoint") and wanted <= near:
            found.add((a, kind, b))
    strong = [tuple(s.split(":")) for s in brute.base_spans(text).split(",") if s]
    ranked = sorted([(int(a), secret_links.KINDS.index(k), int(b)) for k, a, b in strong] + [(a, secret_links.KINDS.index(k), b) for a, k, b in found])
    return ",".join(f"{secret_links.KINDS[k]}:{a}:{b}" for a, k, b in ranked)


def test_registered_query_links_planted_parts(spark, tmp_path):
    rng = random.Random(12)
    parts = [
        lambda: "client_id: robot" + str(rng.randint(1, 99)), lambda: "secret=hunt" + str(rng.randint(10, 9999)),
        lambda: "https://api.example.net/" + str(rng.randint(1, 99)), lambda: "AKIA" + "D" * 16,
        lambda: "k" * rng.randint(40, 60) + "==", lambda: "password='abcdefghijklmnop'", lambda: "é🙂 user_name=anna",
    ]
    texts = []
    for _ in range(150):
        made = [rng.choice(parts)() if rng.random() < 0.15 else "word" for _ in range(rng.randint(1, 250))]
        texts.append(" ".join(made))
    rows = [*enumerate(texts), (900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["spans"] for r in queries.op5_secret_links(spark, str(tmp_path)).collect()}
    assert found == {d: linked_spans(t or "") for d, t in rows}
    assert sum("weak" in s for s in found.values()) > 30 and sum("endpoint" in s for s in found.values()) > 30


@given(st.lists(st.integers(-1000, 1000)))
@settings(deadline=None)
def test_steps_hold_changes_of_any_size(changes):
    steps = token_counts._as_steps(np.array(changes, np.int64))
    assert token_counts.changes_of(steps).tolist() == changes
    assert all(token_counts.count_at(steps, k) == sum(changes[:k]) for k in range(len(changes) + 1))
