"""A group of near copies whose similarities lie around the limit."""

import random

from panelforge.llm import minhash


def test_rows_outside_the_main_component_meet_a_few_of_it_first(spark, monkeypatch):
    rng, rows = random.Random(4), []
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(2, 4)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    met, stored = [], minhash.durable

    def counting(df, label, **options):
        made = stored(df, label, **options)
        if label == "pairs":
            met.append(made.count())
        return made

    monkeypatch.setattr(minhash, "durable", counting)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    parent = list(range(160))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(160):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert found == {i: root(i) for i in range(160)}
    assert max(met) < 3500  # 4512 without the few
