"""The pipeline stage by stage on a small folder of tables, against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, prose(rng, rng.randint(15, 40))) for i in range(12)]
    texts = [prose(rng, rng.randint(30, 200)) for _ in range(120)]
    texts += [texts[i] for i in range(10)]  # exact copies
    for i in range(10, 25):  # near copies
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 20)} {items[i][1]} {prose(rng, 20)}" for i in range(12)]
    texts += [f"BUY!! NOW!! {'CLICK!! HERE!! ' * rng.randint(8, 40)}{i}" for i in range(40)]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(1, texts[1], "en", "a", 5), (None, texts[3] + " once", "en", "b", 5), (6, texts[6] + " twice", None, "b", 5)]
    fresh = [prose(rng, 90) for _ in range(3)]
    rows += [(5, fresh[0], "en", "a", None), (None, fresh[1], "en", "c", 1), (None, fresh[1], "en", "c", 1), (None, fresh[1] + " more", "en", "c", 1)]
    rows += [(900, fresh[2] + " last", "en", "b", 2), (None, fresh[2], "en", "b", 2), (901, prose(rng, 20_000), "en", "a", 3)]
    rows += [(902, None, "en", "a", None), (903, "", "en", "a", 0), (None, "", None, None, None), (None, None, None, None, None)]
    rows = [(*r, r[0], r[1], r[4], "x") for r in rows]
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    schema += ", row_number long, `order` string, component_id long, quality_score string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{path}/documents.parquet")
    marks = [(i, 0 if t.startswith("BUY") else 1, 0) for i, t in enumerate(texts)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_every_stage_works_on_what_the_one_before_kept(spark, folder, tmp_path):
    path, rows, items = folder
    docs, kept, columns = spark.read.parquet(f"{path}/documents.parquet"), {}, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        columns = columns or docs.columns
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[k] = docs.collect()

    def same(stage):
        return sorted(((r["doc_id"], r["text"]) for r in kept[stage]), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))

    full = [r for r in rows if brute.words(r[1])]
    good = [r for r in same(0) if brute.words(r[1])]
    assert Counter(good) == Counter((r[0], r[1]) for r in full if not r[1].startswith("BUY"))
    assert len(kept[0]) - len(good) in (0, len(rows) - len(full))  # rows without words share one score

    groups = brute.near_components([(k, r[1]) for k, r in enumerate(same(0))], 5, 80)
    members = {}
    for k, r in enumerate(same(0)):
        members.setdefault(groups[k], []).append(r)
    left = same(1)
    assert Counter(r[0] for r in left) == Counter(m[0][0] for m in members.values()) and len(left) < len(same(0)) - 25
    assert all(sum(x in m for x in left) >= 1 for m in members.values())
    assert sum(r[0] == 5 for r in left) == 2 and sum(r[0] == 6 for r in left) == 1 and sum(r[0] == 900 for r in left) == 1

    holds = {t: len(t) < 50_000 and any(brute.holds_item(t, x) is not None for _, x in items) for _, t in left if t}
    assert same(2) == [r for r in left if not holds.get(r[1], False)] and len(same(2)) < len(left)

    sizes = {}
    for r in kept[2]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    target, taken = brute.targets(sizes, (5, 2, 1), 1.5, 2), dict.fromkeys(sizes, 0)
    for r in kept[3]:
        taken[r["source"]] += len(brute.words(r["text"]))
    longest = max(len(brute.words(r["text"])) for r in kept[2])
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in sizes)
    assert set(same(3)) <= set(same(2))

    library, at, encoded = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, Counter()
    for doc_id, text in same(3):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        encoded[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    last = sorted(kept[4], key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in last) == encoded
    for r in last:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in last]
    assert order == sorted(order)


def test_run_repeats_itself(spark, folder):
    first, second = (sorted(map(str, corpus_pipeline.run(spark, folder[0]).collect())) for _ in range(2))
    assert first == second and first


def test_empty_tables_pass_through(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
