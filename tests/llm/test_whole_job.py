"""Results that a cut would change."""

import random

import pytest
from pyspark.sql import functions as F

from panelforge.llm import compression_quality, decontaminate, queries
from tests.llm import brute
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def many_words():
    """More words than a small table of contexts holds, and phrases of rare words that come again."""
    rng = random.Random(4)
    phrases = [[f"r{i}a", f"r{i}b", f"r{i}c"] for i in range(2500)]
    docs = []
    for d in range(400):
        text = []
        for _ in range(rng.randint(5, 30)):
            text += rng.choice(phrases) if rng.random() < 0.6 else rng.choices(["the", "of", "and", "to"], k=3)
        docs.append((d, " ".join(text)))
    return [*docs, (900, None), (901, "words never seen anywhere else")]


def test_query_counts_every_pair(spark, many_words, tmp_path):
    spark.createDataFrame(many_words, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["score"] for r in queries.op4_interpolated_lm(spark, str(tmp_path)).collect()}
    expected = brute.interpolated_scores(many_words)
    assert found.keys() == expected.keys()
    assert all(found[d] == pytest.approx(expected[d], rel=1e-9) for d in found)


def nearest_span(text, item, max_edits=0.2):
    """The least distance of any span of the text, if it is small enough."""
    target = brute.words(item, lower=True)
    line = [0] * (len(brute.words(text)) + 1)
    for i, x in enumerate(target, 1):
        above, line = line, [i]
        for j, y in enumerate(brute.words(text, lower=True), 1):
            line.append(min(above[j] + 1, line[-1] + 1, above[j - 1] + (x != y)))
    return min(line) if min(line) <= int(len(target) * max_edits + 1e-9) else None


@pytest.mark.parametrize("kind", ["left out", "put in", "replaced", "run left out", "run put in"])
def test_passages_are_met_whatever_the_edits(spark, kind):
    rng = random.Random(kind)
    pool = [f"w{i}" for i in range(500)]
    items = [(i, rng.choices(pool, k=rng.randint(15, 50))) for i in range(60)]
    docs = []
    for i, item in items:
        edits, passage = int(len(item) * 0.2), list(item)
        if kind.startswith("run"):
            at = rng.randint(0, len(item) - edits)
            passage[at : at + edits * (kind == "run left out")] = ["new"] * edits * (kind == "run put in")
        else:
            for at in sorted(rng.sample(range(len(item)), edits), reverse=True):
                passage[at : at + (kind != "put in")] = ["new"] * (kind != "left out")
        before, after = (rng.choices(pool, k=rng.choice([0, 3, 60])) for _ in range(2))
        docs.append((i, " ".join([*before, *passage, *after])))
    texts = {i: " ".join(item) for i, item in items}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.contaminations(table, spark.createDataFrame(list(texts.items()), "item_id long, text string")).collect()
    for r in found:
        words = brute.words(dict(docs)[r["doc_id"]], lower=True)[r["start_word"] : r["start_word"] + r["n_words"]]
        assert r["start_word"] >= 0 and len(words) == r["n_words"]
        assert brute.edit_distance(words, brute.words(texts[r["item_id"]])) == r["distance"]
    truth = {(d, i): gap for d, text in docs for i, item in texts.items() if (gap := nearest_span(text, item)) is not None}
    pairs = {(r["doc_id"], r["item_id"]): r["distance"] for r in found}
    assert len(truth) >= len(docs) and pairs.items() <= truth.items() and len(pairs) >= 0.97 * len(truth)


def labelled(spark, extra):
    """Good and few bad texts, the bad ones last in the order of the sample; ``extra`` labels have no text."""
    rng = random.Random(8)
    order = [r[0] for r in spark.range(1000).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("id")).collect()]
    bad = set(order[-30:])
    rows = [(i, "CLICK!! NOW!! FREE!! " * rng.randint(3, 9) + str(i) if i in bad else prose(rng, 60)) for i in order]
    marks = [(i, int(i not in bad)) for i in order] + [(10_000 + i, i % 2) for i in range(extra)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int"), bad


@pytest.mark.parametrize("extra", [0, 20_000])
def test_rare_bad_labels_count_and_labels_without_texts_do_not(spark, extra):
    docs, marks, bad = labelled(spark, extra)
    model = compression_quality.fit(docs, marks, dictionary_rows=40, calibration_rows=100)
    scored = compression_quality.score(docs, model).collect()
    assert model and {r["doc_id"] for r in scored if r["quality_score"] < 0.3} == bad
    if extra:
        assert model == compression_quality.fit(docs, labelled(spark, 0)[1], dictionary_rows=40, calibration_rows=100)
