"""Each operator against plain Python, on rows with nulls, ties, repeats, odd texts and clashing columns."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import (
    components,
    compression_quality,
    decontaminate,
    divergence,
    interpolated_lm,
    minhash,
    mixing,
    secret_links,
    token_counts,
    token_files,
    url_rules,
)
from panelforge.storage import new_path
from tests.llm import brute

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def empty(df):
    return df.limit(0)


# 1. Quality rules


def test_base_counts_of_odd_texts(edges, edge_rows):
    found = divergence.document_features(edges).select(*divergence.COUNTS).collect()
    assert sorted(map(tuple, found)) == sorted(brute.base_counts(r[1]) for r in edge_rows)


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=60, deadline=None)
def test_repeated_words_of_any_sequence(codes):
    text = " ".join("abcd"[c] for c in codes)
    assert divergence.repeated_words(np.array(codes, np.int64)) == brute.base_counts(text)[4]


def test_distance_is_jensen_shannon(spark):
    p, q = [6, 3, 1, 0], [0.25, 0.25, 0.25, 0.25]
    m = [(x / 10 + y) / 2 for x, y in zip(p, q)]
    expected = sum((x / 10) * math.log2(x / 10 / z) for x, z in zip(p, m) if x) + sum(y * math.log2(y / z) for y, z in zip(q, m))
    df = spark.createDataFrame([(p, 10, q), ([0] * 4, 0, q)], "p array<long>, n long, q array<double>")
    found = df.select(divergence.js_distance(F.col("p"), F.col("n"), F.col("q"))).collect()
    assert found[0][0] == pytest.approx(math.sqrt(expected / 2)) and found[1][0] is None


def test_quality_rules_drop_junk_and_keep_prose(spark, edges, edge_rows):
    rng = random.Random(3)
    prose = [r[1] for r in edge_rows if r[1] and 60 <= len(brute.words(r[1])) <= 200 and r[0] != 12]
    rows = [(i, " ".join(rng.sample(brute.words(rng.choice(prose)), 60)), "en") for i in range(150)]
    rows += [(1000 + i, rows[i][1].upper().replace(" ", "!! "), "en") for i in range(10)]
    judged = divergence.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in judged.where("kept").collect()}
    assert kept == set(range(150))
    assert divergence.judge_quality(edges).count() == len(edge_rows)
    assert divergence.judge_quality(empty(edges)).count() == 0


# 2. Benchmark decontamination


def test_edited_passages_are_found_and_others_left(spark, edges, edge_rows):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(12, 50)))) for i in range(30)]
    docs, truth = [], set()
    for d in range(150):
        body = rng.choices(pool, k=rng.randint(5, 120))
        if d % 3 == 0:
            i, text = rng.choice(items)
            passage = text.split()
            for _ in range(rng.randint(0, int(len(passage) * 0.15))):
                at = rng.randrange(len(passage))
                passage[at : at + rng.randint(0, 1)] = rng.choice([[], ["new"]])
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() for w in passage]
        docs.append((d, "\n".join(body)))
        truth |= {(d, i) for i, text in items if brute.holds_item(docs[-1][1], text) is not None}
    df = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame([*items, items[0], (77, None), (78, "too short")], "item_id long, text string")
    found = decontaminate.contaminations(df, benchmark).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert pairs <= truth and len(pairs) >= 0.97 * len(truth) and len(pairs) == len(found)
    by_id = dict(docs)
    for r in found:
        window = brute.words(by_id[r["doc_id"]], lower=True)[r["start_word"] : r["start_word"] + r["n_words"]]
        assert brute.edit_distance(window, brute.words(dict(items)[r["item_id"]], lower=True)) == r["distance"]
    blocks = decontaminate.contaminations(df, benchmark, block_items=7).select("doc_id", "item_id")
    assert {tuple(r) for r in blocks.collect()} >= {p for p in pairs if brute.holds_item(by_id[p[0]], dict(items)[p[1]]) == 0}
    clean = decontaminate.without_contaminated(df, benchmark)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in pairs} | {900, 901}
    assert decontaminate.contaminations(edges, empty(benchmark)).count() == 0
    assert decontaminate.contaminations(empty(edges), benchmark).count() == 0
    assert decontaminate.without_contaminated(edges, benchmark).count() == len(edge_rows)


@given(st.lists(st.integers(2, 5), min_size=1, max_size=8), st.lists(st.integers(2, 5), min_size=1, max_size=12))
@settings(max_examples=80, deadline=None)
def test_nearest_span_of_rows(item, text):
    found = decontaminate.nearest_spans(np.array([item]), np.array([text + [1, 1]]), np.array([len(item)]))
    gap, start, size = (int(x[0]) for x in found)
    spans = [text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1)]
    assert gap == brute.edit_distance(item, text[start : start + size]) == min(brute.edit_distance(item, x) for x in spans)


def test_items_without_room_for_an_edit_are_equal_runs(spark):
    rng = random.Random(4)
    pool = list("abcdefgh")
    docs = [(d, " ".join(rng.choices(pool, k=rng.randint(0, 12)))) for d in range(200)] + [(500, None), (501, "A B"), (502, "a")]
    items = [(i, " ".join(rng.choices(pool, k=1 + i % 4))) for i in range(24)] + [(90, ""), (91, None), (92, "a b"), (93, "A  b")]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    truth = {}
    for d, text in docs:
        w = brute.words(text, lower=True)
        for i, item in items:
            t = brute.words(item, lower=True)
            at = [k for k in range(len(w) - len(t) + 1) if w[k : k + len(t)] == t] if t else []
            if at:
                truth[d, i] = (at[0], len(t), 0)
    for block in (5000, 5):
        found = decontaminate.contaminations(df, benchmark, block_items=block).collect()
        assert {(r[0], r[1]): tuple(r)[2:] for r in found} == truth and len(found) == len(truth)
        clean = decontaminate.without_contaminated(df, benchmark, block_items=block).collect()
        assert {r["doc_id"] for r in clean} == {d for d, _ in docs} - {d for d, _ in truth}


def test_a_long_item_needs_no_more_memory_beside_short_texts(spark):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(3000)]
    long = rng.choices(pool, k=1100)
    edited = [w if rng.random() > 0.02 else "new" for w in long]
    small = [" ".join(rng.choices(pool, k=3)) for _ in range(2000)]
    items = decontaminate.prepare([{"item_id": 1, "text": " ".join(long)}, {"item_id": 2, "text": " ".join(pool[:20])}])
    texts = pa.array([*small, " ".join([*pool[:10], *edited, *pool[:20]])])
    tracemalloc.start()
    row, item, start, size, gap = decontaminate._matches(texts, items, pa.array(items.words))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert row.tolist() == [2000, 2000] and item.tolist() == [0, 1]
    assert start.tolist() == [10, 1110] and size.tolist() == [1100, 20] and gap.tolist() == [edited.count("new"), 0]


def test_a_recall_out_of_reach_is_refused(monkeypatch):
    item = [{"item_id": 1, "text": " ".join(map(str, range(40)))}]
    assert decontaminate.prepare(item).repetitions > 8
    monkeypatch.setattr(decontaminate, "MOST_REPETITIONS", 8)
    with pytest.raises(ValueError, match="not reached"):
        decontaminate.prepare(item)


# 3. Token files and 9. token counts


def test_token_files_hold_the_library_ids_in_order(spark, edges, edge_rows):
    library = Tokenizer.from_file(WORD_BPE)
    path = new_path(spark, "tokens")
    token_files.write_token_files(edges, path, WORD_BPE, 2, index_rows=1000)
    back = token_files.read_token_files(spark, path)
    expected = sorted(
        (r[0] is not None, r[0] or 0, library.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in edge_rows
    )
    found = back.orderBy("file", "place").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["tokens"]) for r in found) == expected
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in found]
    assert ids == sorted(ids)
    digests = token_files.with_starts(token_files.digest_token_files(back)).orderBy("start").collect()
    at = 0
    for row, digest in zip(found, digests, strict=True):
        data = np.array(row["tokens"], "<u4").tobytes()
        assert (digest["start"], digest["n_tokens"], digest["ids_crc32"]) == (at, len(row["tokens"]), zlib.crc32(data))
        at += len(row["tokens"])
    one = token_files.read_token_files(spark, path).where("doc_id = 7")
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().executedPlan().toString()
    none = new_path(spark, "tokens")
    token_files.write_token_files(empty(edges), none, WORD_BPE, 2)
    assert token_files.read_token_files(spark, none).count() == 0


ODD = st.lists(st.sampled_from([*"aethTHE  \n\t'rvlsd!.,1=é\xa0\x1c\u2003🙂ßΣ", "<|endoftext|>"]), max_size=40).map("".join)


@given(st.lists(ODD, min_size=1, max_size=8))
@settings(max_examples=40, deadline=None)
def test_word_encoder_equals_the_library(texts):
    encoder = token_files.word_encoder(WORD_BPE)
    ids, ends = encoder(pa.array(texts), 2)
    for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE_BPE)


@given(st.lists(ODD, min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_counts_of_all_prefixes_equal_the_library(byte_library, texts):
    for text, steps in zip(texts, token_counts.prefix_counter(BYTE_BPE)(pa.array(texts)).to_pylist(), strict=True):
        for k in range(len(text) + 1):
            assert token_counts.count_at(steps, k) == len(byte_library.encode(text[:k], add_special_tokens=False).ids)


def test_prefix_counts_of_odd_rows(byte_library, edges, edge_rows):
    found = token_counts.prefix_counts(edges, BYTE_BPE, 20).collect()
    count = lambda t: len(byte_library.encode(t, add_special_tokens=False).ids)
    expected = [(r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in edge_rows]
    key = lambda r: (r[0] is not None, *map(int, (r[0] or 0, r[1], r[2])))
    assert sorted((tuple(r)[:3] for r in found), key=key) == sorted(expected, key=key)
    texts = {r[0]: r[1] or "" for r in edge_rows if r[0] is not None and r[0] != 11}
    for r in found:
        if r["doc_id"] in texts and len(texts[r["doc_id"]]) < 2000:
            text, n = texts[r["doc_id"]], r["chars_in_budget"]
            assert n == token_counts.cut_to(r["steps"], 20) == max(k for k in range(len(text) + 1) if count(text[:k]) <= 20)
    assert token_counts.prefix_counts(empty(edges), BYTE_BPE, 20).count() == 0


# 4. Scores of a language model


@pytest.mark.parametrize(("keys_per_part", "slice_bytes"), [(1 << 20, 8 << 20), (50, 400)])
def test_scores(spark, edges, edge_rows, keys_per_part, slice_bytes):
    """Rows without an id and texts that share one are scored each; neither size changes a result."""
    held, left = lambda c: c % 7 == 2, lambda c: c % 7 == 3
    found = interpolated_lm.score_by_all_pairs(edges, held, left, 25, keys_per_part, slice_bytes).collect()
    docs = [((r[0], i), r[1]) for i, r in enumerate(edge_rows)]
    base, total = brute.base_scores(docs, key=lambda d: d[0])
    scores = brute.interpolated_scores(docs, key=lambda d: d[0])
    keyed = lambda d: (d is None, d or 0)
    expected = sorted(((*keyed(d[0]), *base[d], scores[d]) for d, _ in docs))
    assert len(found) == len(expected)
    rows = sorted((*keyed(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in found)
    for got, want in zip(rows, expected, strict=True):
        assert got[:4] == want[:4] and got[4:] == pytest.approx(want[4:], rel=1e-9)
    assert {r["train_tokens"] for r in found} == {total}


def test_model_of_no_rows(edges, edge_rows):
    nothing = interpolated_lm.score_by_all_pairs(edges, lambda c: c >= 0, lambda c: c % 7 == 3).collect()
    assert len(nothing) == len(edge_rows) and all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in nothing)
    assert interpolated_lm.score_by_all_pairs(empty(edges), lambda c: c % 7 == 2, lambda c: c % 7 == 3).count() == 0


@given(st.lists(st.integers(0, (1 << 64) - 1)))
@settings(deadline=None)
def test_packed_numbers_come_back(values):
    packed = interpolated_lm._pack(np.array(values, np.uint64))
    assert interpolated_lm._unpack(packed).tolist() == values


# 5. Secrets


def test_base_spans(spark, edges, edge_rows):
    key = "AKIA" + "B" * 16
    texts = [
        f"x {key} y", "password = abcdefghijkl, token:short", 'api_key="ABCDEFGHIJKLMN"', "token: token: abcdefghijklmnop",
        "é🙂 0123456789abcdef0", "a" * 15 + " " + "b" * 40, "PassWD='aaaaaaaaaaaa' secret=bbbbbbbbbbbbb", "AKIAAKIA" + "C" * 12,
        "to\u212aen=abcdefghijklmnop", None, "",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in edge_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = secret_links.find_secrets(df).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    expected = sorted([(i, brute.base_spans(t)) for i, t in rows], key=key)
    assert sorted([(r["doc_id"], r["base_spans"]) for r in found], key=key) == expected
    assert secret_links.find_secrets(empty(edges)).count() == 0
    assert secret_links.find_secrets(edges).count() == len(edge_rows)


def test_weak_parts_count_only_together(spark):
    far = " word" * 100
    both = "client_id: robot7 secret=hunter22"
    url = "https://api.example.net/v1"
    texts = {
        1: both, 2: "client_id: robot7" + far + " secret=hunter22", 3: "secret=hunter22 alone", 4: "client_id: robot7 alone",
        5: f"{url} {both}", 6: url, 7: f"{url}{far} {both}", 8: "AKIA" + "D" * 16 + " " + "k" * 40,
    }
    df = spark.createDataFrame([*texts.items(), (5, texts[5])], "doc_id long, text string")
    found = {}
    for r in secret_links.find_secrets(df).collect():
        found.setdefault(r["doc_id"], set()).add(tuple(texts[r["doc_id"]][s["start"] : s["end"]] for s in sorted(r["linked"], key=lambda s: s["start"])))
    pair = ("client_id: robot7", "secret=hunter22")
    assert found == {1: {pair}, 2: {()}, 3: {()}, 4: {()}, 5: {(url, *pair)}, 6: {()}, 7: {pair}, 8: {("k" * 40,)}}


# 6. Near copies


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_copies_equal_all_pairs(spark, edges, k, percent):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
    docs, last = [], base
    for i in range(120):  # a family that drifts, and single texts
        last = list(rng.choice([base, last]))
        for _ in range(rng.randint(0, 4)):
            last[rng.randrange(len(last))] = f"n{rng.randint(0, 9999)}"
        docs.append((1000 - i, " ".join(last)))
    docs += [(i, " ".join(rng.choices(base, k=rng.randint(1, 6)))) for i in range(40)]
    docs += [(2000 + i, docs[3][1].upper()) for i in range(30)] + [(3000, None), (3001, ""), (3002, "one"), (3003, "ONE")]
    found = minhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), k, percent).collect()
    expected = brute.near_components(docs, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    texts = dict(docs)
    assert all(r["n_shingles"] == len(brute.shingles(texts[r["doc_id"]], k)) for r in found)
    odd = minhash.near_copies(edges, k, percent)
    assert odd.count() == edges.count() and odd.where("doc_id IN (1, 2)").select("component_id").distinct().count() == 1
    assert minhash.near_copies(empty(edges), k, percent).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 400).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.sql("SELECT 900L AS a, 901L AS b"))
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert found == {**dict.fromkeys(range(1, 401), 1), 900: 900, 901: 900}


def test_estimate_is_near_the_similarity(spark):
    texts = [" ".join(f"a{i}" for i in range(n, n + 1000)) for n in (0, 100, 300)]
    rows = minhash.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3)
    pair = rows.alias("x").join(rows.alias("y"), F.col("x.doc_id") < F.col("y.doc_id"))
    for r in pair.select("x.doc_id", F.col("y.doc_id").alias("other"), minhash.estimate("x", "y").alias("e")).collect():
        a, b = brute.shingles(texts[r["doc_id"]], 3), brute.shingles(texts[r["other"]], 3)
        assert abs(r["e"] - len(a & b) / len(a | b)) < 0.15


# 7. Quality classifier


def test_classifier_learns_and_is_repeatable(spark, edges, edge_rows, labels):
    good, bad = [r[1] for r in edge_rows if r[0] and r[0] >= 100], "CLICK!! NOW!! FREE!! "
    rows = [(i, good[i % len(good)] + f" {i}") for i in range(200)] + [(500 + i, bad * (i % 7 + 3) + str(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(d, int(d < 500)) for d, _ in rows], "doc_id long, quality int")
    model = compression_quality.fit(docs, marks)
    scored = compression_quality.score(docs, model).collect()
    held = [r for r in scored if brute.crc(r["doc_id"]) % 5 == 0]
    assert held and all((r["quality_score"] >= 0.3) == (r["doc_id"] < 500) for r in held)
    assert compression_quality.fit(docs, marks) == model
    assert compression_quality.fit(docs, empty(marks)) is None
    model = compression_quality.fit(edges, labels)
    found = compression_quality.score(edges, model, "score").collect()
    assert len(found) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in found)
    assert compression_quality.score(empty(edges), model, "score").count() == 0
    with pytest.raises(ValueError, match="quality_score"):
        compression_quality.score(edges, model)


# 8. Mixing


def test_targets_and_copies(spark, edges, edge_rows):
    planned = mixing.plan_copies(edges).collect()
    assert len(planned) == len(edge_rows)
    sizes = {}
    for r in edge_rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    target = brute.targets(sizes, (5, 2, 1), 1.5, 2)
    for r in planned:
        source = r["row"]["source"]
        assert r["size"] == len(brute.words(r["row"]["text"])) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(target[source]) and 0 <= r["copies"] <= 2
    key = lambda r: repr(r)
    again = mixing.plan_copies(edges.repartition(5)).collect()
    assert sorted((key(r["row"]), r["copies"]) for r in again) == sorted((key(r["row"]), r["copies"]) for r in planned)
    mixed = mixing.mix(edges)
    assert mixed.columns == edges.columns and mixed.count() == sum(r["copies"] for r in planned)
    assert mixing.plan_copies(empty(edges)).count() == 0


def test_one_source_of_many_rows_is_ranked_over_many_tasks(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 + 1 as int)) AS text", "if(id % 3 = 0, 'big', concat('s', id % 40)) AS source")
    planned = mixing.plan_copies(docs)
    taken = planned.groupBy("row.source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 14 for r in taken)


# 10. URL rules


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow")]
    urls = [
        None, "no scheme", "", "http://", "HTTP://A.Example.ORG/es/x?y#z", "https://example.org/en/17", "http://x.com/fr/",
        "http://org", "http://xorg/", "http://a..org/", "a://b://c.org/", "http://.org/x", "x\n://q.com/fr/\n?",
        "http://example.org/es", "http://example.org/es/", "http://EXAMPLE.org?/es/",
    ]

    def expected(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        tail = url.split("://", 1)[1]
        cut = min([tail.find(c) for c in "/?#" if c in tail] or [len(tail)])
        host, rest = tail[:cut].translate(brute.UPPER), tail[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    pages = spark.createDataFrame([(i % 15, u, "x") for i, u in enumerate([*urls, *urls])], "page_id long, url string, rule string")
    table = spark.createDataFrame([*rules, rules[0], (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    found = url_rules.judge(pages, table).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, found), key=key) == sorted([(i % 15, *expected(u)) for i, u in enumerate([*urls, *urls])], key=key)
    assert url_rules.judge(empty(pages), table).count() == 0
    assert all(r["rule"] is None for r in url_rules.judge(pages, empty(table)).collect())
