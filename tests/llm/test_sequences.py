"""Toxicity, fill-in-the-middle and the conversation trie against plain Python, on odd rows too."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import conversation_trie, fill_in_middle, queries, toxicity
from tests.llm.conftest import prose

# 11. Toxicity

BAD = ["grok", "snarfle", "blorp"]


def plain_odds(text, model):
    """The network's output for one text, place by place."""
    number = {int(b): v for b, v in zip(model.buckets, model.vectors, strict=True)}
    none = np.zeros(toxicity.DIM)
    vectors = []
    for word in text.lower().split():
        vectors.append(sum((number.get(int(b), none) for b in toxicity.word_buckets(pa.array([word]))[0]), none))
    hidden = []
    for kernel in model.filters:
        answers = []
        for i in range(max(len(vectors), 1)):
            parts = [vectors[i + o] if i + o < len(vectors) else none for o in range(len(kernel))]
            answers.append(sum(p @ m for p, m in zip(parts, kernel, strict=True)))
        hidden += list(np.max(answers, axis=0))
    return float(np.maximum(np.array(hidden) + model.biases, 0) @ model.weights + model.bias)


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        words = prose(rng, rng.randint(5, 120)).split()
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD) + rng.choice(["", ".", "thon"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 1, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


@pytest.fixture(scope="module")
def network(insults):
    return toxicity.fit(insults[0], insults[1], steps=300)


def test_toxic_texts_not_learned_from_are_told(insults, network):
    found = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(insults[0], network).collect()}
    held = [(found[i] >= toxicity.CUT, y) for i, _, y in insults[2] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p for p, y in held if y) >= 0.95 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.01 * len(held)


def test_network_output_is_its_definition(insults, network):
    texts = [t for _, t, _ in insults[2][:25]] + ["", "   ", "one", "grok", "snarfle blorp.", "GROK " * 40]
    found = toxicity.log_odds(toxicity.words_of(pa.array([*texts, None])), network)
    assert np.allclose(found, [plain_odds(t, network) for t in [*texts, ""]], atol=1e-4)


def test_reruns_agree_and_only_the_text_counts(spark, insults, network):
    again = toxicity.fit(insults[0].repartition(5), insults[1].repartition(3), steps=300)
    assert np.array_equal(again.vectors, network.vectors) and np.array_equal(again.thresholds, network.thresholds)
    rows = [(1, "you grok blorp", "en"), (2, "you grok blorp", "fr"), (None, "you grok blorp", None)]
    scores = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), network).collect()
    assert len({r["toxic_score"] for r in scores}) == 1


def test_all_labelled_rows_are_learned_from(spark, insults):
    """Toxic words met only in texts beyond 32 KB, and rows in many shards."""
    docs, labels, rows = insults
    rng = random.Random(8)
    long = [(10_000 + i, " ".join([prose(rng, 60), "zqx", "padding " * 5000])) for i in range(24)]
    more = docs.unionByName(spark.createDataFrame([(i, t, "en") for i, t in long], "doc_id long, text string, lang string"))
    marks = labels.unionByName(spark.createDataFrame([(i, 1, 1) for i, _ in long], "doc_id long, quality int, toxic int"))
    model = toxicity.fit(more, marks, steps=200, shard_rows=150)
    assert int(toxicity.word_buckets(pa.array(["zqx"]))[0][0]) in model.buckets.tolist()
    again = toxicity.fit(more.repartition(7), marks.repartition(2), steps=200, shard_rows=150)
    assert np.array_equal(again.vectors, model.vectors) and np.array_equal(again.thresholds, model.thresholds)
    found = {r["doc_id"]: r["toxic_score"] >= toxicity.CUT for r in toxicity.score(docs, model).collect()}
    held = [(found[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)


def test_no_limit_lies_between_equal_values():
    values, labels = np.array([0.0, 1.0, 1.0, 2.0]), np.array([0, 0, 1, 1])
    limits = toxicity.thresholds(values, labels, np.zeros(4, int), np.array([5.0, 1.0, 9.0, 5.0]))
    assert ((limits < 1) & (limits > 0)).all()


def test_toxicity_shuffles_labelled_texts_once_a_step(insults, monkeypatch):
    """Texts without a label are filtered before they are shuffled, and shards are dealt once, not in every turn."""
    plans, stored = {}, toxicity.durable

    def noting(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(toxicity, "durable", noting)
    docs, labels, _ = insults
    spark = docs.sparkSession
    before = {key: spark.conf.get(key, None) for key in toxicity.PRUNED}
    toxicity.fit(docs, labels.where("doc_id < 500"), steps=5, shard_rows=150)
    assert "might_contain" in plans["toxic-rows"][0]
    assert [plan.count("Exchange") for plan in plans["toxic-pieces"]] == [1, 1, 1]
    assert {key: spark.conf.get(key, None) for key in toxicity.PRUNED} == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("clustered_")]


def test_toxicity_of_odd_rows(spark, edges, network):
    found = toxicity.score(edges, network)
    assert found.columns == [*edges.columns, "toxic_score_language", "toxic_score"] and found.count() == edges.count()
    rows = found.collect()
    assert all(0 <= r["toxic_score"] <= 1 for r in rows)
    assert len({r["toxic_score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert toxicity.score(edges.limit(0), network).count() == 0
    assert {r[0] for r in toxicity.score(edges, None).select("toxic_score").collect()} == {0.5}
    with pytest.raises(ValueError, match="column"):
        toxicity.score(edges.withColumnRenamed("lang", "toxic_score"), network)


def test_one_class_gives_no_model(spark, insults):
    assert toxicity.fit(insults[0], insults[1].where("toxic = 0")) is None
    assert toxicity.fit(insults[0].limit(0), insults[1]) is None


def test_language_is_told_by_words():
    texts = ["the end of it", "der Hund und das Tier", "les gens dans une ville", "los perros en las calles", "xyz", "", "the der"]
    found = toxicity.language_of(toxicity.words_of(pa.array(texts)))
    assert found.tolist() == [0, 1, 2, 3, 4, 4, 4]


def test_threshold_makes_fewest_errors():
    rng = np.random.default_rng(0)
    values, labels, languages = rng.normal(0, 1, 400), rng.integers(0, 2, 400), rng.integers(0, 3, 400)
    values += 2 * labels + languages
    limits = toxicity.thresholds(values, labels, languages, np.ones(400))
    for k in range(3):
        weight = (languages == k) + 20 / 400
        cost = [float((weight * ((values >= t) != labels)).sum()) for t in [*(values + 1e-9), limits[k]]]
        assert cost[-1] <= min(cost) + 1e-9
    assert toxicity.thresholds(np.array([]), np.array([]), np.array([]), np.array([])).tolist() == [0] * 5


@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_buckets_depend_on_the_word_alone(words):
    both = toxicity.word_buckets(pa.array(words))
    for word, own in zip(words, both, strict=True):
        assert toxicity.word_buckets(pa.array([word]))[0].tolist() == own.tolist()
        size = len(word.encode())
        assert [b == toxicity.BUCKETS for b in own[1:]] == [size <= k for k in toxicity.BEGINNINGS]


# 12. Fill-in-the-middle


def plain_form(doc_id, text, seed=1):
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text, text
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    parts = {"P": text[:a], "M": text[a:b], "S": text[b:]}
    spm = h[3] % 100 < 20
    output = "".join(f"<{p}>{parts[p]}" for p in ("SPM" if spm else "PSM"))
    return doc_id, len(text), "spm" if spm else "psm", a, b - a, output, text


def key(row):
    return [(x is None, x) for x in row]


def test_forms_equal_the_definition(spark, edges, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows]
    marks = ["<", "<S", "<S<P", "a<P>b", "P>S>M>", "<M", "<<<", "🙂<", "\x00", "a\r\nb"]
    rows += [(1000 + i, marks[i % len(marks)] * (1 + i // 40) + "x" * (i % 4)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS output", "doc_id AS n", "text AS form")
    made = fill_in_middle.fill_in_middle(docs)
    found = [tuple(r) for r in made.withColumn("restored", fill_in_middle.restored_text()).collect()]
    expected = [plain_form(d, t) for d, t in rows]
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(edges.limit(0)).count() == 0


def test_long_texts_are_matched_in_stretches(monkeypatch):
    text = "añ🙂\n" * 1000 + "z"
    whole = fill_in_middle.unit_ends(text)
    assert whole.tolist() == list(range(1, len(text) + 1))
    monkeypatch.setattr(fill_in_middle, "STRETCH", 7)
    fill_in_middle._patterns.cache_clear()
    assert fill_in_middle.unit_ends(text).tolist() == whole.tolist()
    fill_in_middle._patterns.cache_clear()


@given(st.text(max_size=80))
@settings(max_examples=60, deadline=None)
def test_units_may_be_graphemes_or_words(text):
    assert fill_in_middle.unit_ends(text, r"\X").tolist() == [m.end() for m in regex.finditer(r"\X", text)]
    assert fill_in_middle.unit_ends(text, r"(?:\s+|\S+)").tolist() == [m.end() for m in regex.finditer(r"\s+|\S+", text)]


def test_units_must_cover_the_text():
    with pytest.raises(ValueError, match="not made"):
        fill_in_middle.unit_ends("ab1", "[a-z]")
    with pytest.raises(ValueError, match="empty"):
        fill_in_middle.unit_ends("ab", "[a-z]?")


# 13. Conversation trie


def plain_trie(rows):
    """Nodes by their definition, from a dictionary of all prefixes."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0, said), (role, text)))
    turns = {c: [x for _, x in sorted(own)] for c, own in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children, found = {}, []
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[b] for b in below) or 1
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[b] for b in below)
    for path, own in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        found.append((min(own), len(path), parent, len(own), len(children.get(path, [])), leaves[path], saved[path], digest))
    return sorted(found, key=key)


def talks(rng, n, texts, longest):
    rows = []
    for c in range(n):
        for turn in range(rng.randint(0, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(texts)))
    return rows


ODD = [
    (None, 1, "user", "nobody"), (50, None, "user", "first"), (50, 1, None, "second"), (50, 1, None, "second"), (50, 1, "user", None),
    (51, 2, "", ""), (53, 0, "us", "erhi"), (53, 0, "user", "hi"), (-7, 0, "user", "below"), (-5, 0, "user", "zero é 🙂"), (-5, 1, "a", "x" * 5000),
    (0, 0, "user", "hi"), (2**63 - 1, 0, "user", "hi"), (-(2**63), 3, "user", "hi"), (777, 5, "assistant", "alone"),
]


@pytest.mark.parametrize("case", ["few texts", "many texts", "odd", "same", "one long", "small blocks"])
def test_nodes_equal_the_definition(spark, monkeypatch, case):
    rng = random.Random(case)
    rows = talks(rng, 120, ["a", "bé", "🙂"] if case != "many texts" else [prose(rng, 9) for _ in range(40)], 12)
    if case == "odd":
        rows = ODD + rows[:60]
    elif case == "same":
        rows = [(c, t, "user", f"turn {t}") for c in range(0, 600, 5) for t in range(6)] + rows
    elif case == "one long":
        rows += [(1000, t, "user", str(t % 7)) for t in range(5000)] + [(1005, t, "user", str(t % 7)) for t in range(4500)]
    elif case == "small blocks":
        monkeypatch.setattr(conversation_trie, "BLOCK", 3)
        monkeypatch.setattr(conversation_trie, "LISTED", 2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "text AS depth", "turn AS x1", "role AS said", "conv_id AS rep")
    found = sorted(map(tuple, conversation_trie.trie(df.repartition(7)).collect()), key=key)
    assert found == plain_trie(rows)


def test_no_conversation_has_no_node(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert conversation_trie.trie(df).count() == 0 and conversation_trie.trie(df.limit(0)).count() == 0


def test_queries_return_their_columns(spark):
    made = {name: queries.QUERIES[name](spark, "/root/testdata/sf0.001") for name in ("op11_toxicity", "op12_fill_in_middle", "op13_prefix_trie")}
    assert made["op11_toxicity"].columns[:4] == ["doc_id", "held_out", "score", "predicted"] and made["op11_toxicity"].count() == 200
    assert made["op12_fill_in_middle"].count() == 200 and made["op13_prefix_trie"].where("depth = 0").count() == 1
