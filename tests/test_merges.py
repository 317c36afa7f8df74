"""As-of joins and sub-periods from blocks, against plain Python and with one key that holds a third of the rows."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelforge.operators import asof, blocks
from panelforge.operators.asof import asof_join
from tests.test_scale import settings

LEFT, RIGHT = "k long, t int, kept string", "k long, s int, v int, kept string"


def latest(left, right):
    out = []
    for k, t, kept in left:
        own = [(s, v) for kk, s, v, _ in right if kk == k and k is not None and s is not None and t is not None and s <= t]
        out.append((k, t, kept, *(max(own) if own else (None, None))))
    return sorted(out, key=str)


def found(spark, left, right):
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    return sorted(map(tuple, asof_join(a, b, ["k"], "t", "s", {"at_s": "s", "v2": "v"}, ["v"]).collect()), key=str)


def test_asof_join_equals_its_definition(spark):
    rng = random.Random(2)
    left = [(rng.choice([1, 1, 1, 2, 3, 9, None]), rng.choice([None, *range(40)]), "x") for _ in range(400)]
    right = [(rng.choice([1, 1, 2, 3, None]), rng.choice([None, *range(0, 40, 3)]), rng.randint(0, 5), "y") for _ in range(120)]
    assert found(spark, left, right) == latest(left, right)
    assert found(spark, left, right[:0]) == latest(left, [])
    assert found(spark, left[:0], right) == []


def test_a_key_with_a_third_of_the_rows_is_split(spark, monkeypatch):
    stored = {}
    real = asof.durable
    monkeypatch.setattr(asof, "durable", lambda df, label: stored.setdefault(label, real(df, label)))
    left = spark.range(60_000).selectExpr("IF(id % 3 = 0, -1, id) AS k", "int(id) AS t", "'' AS kept")
    right = spark.range(100).selectExpr("-1L AS k", "int(id * 600 + 1) AS s", "int(id) AS v", "'' AS kept")
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        joined = asof_join(left, right, ["k"], "t", "s", {"v": "v"})
    hot = joined.where("k = -1").selectExpr("count(*)", "count_if(v <=> IF(t = 0, NULL, int((t - 1) div 600)))").first()
    assert tuple(hot) == (20_000, 20_000)
    assert joined.count() == 60_000 and joined.where("k <> -1 AND v IS NOT NULL").count() == 0
    tasks = stored["asof"].where("key_0 = -1").groupBy(F.shiftright("number", 33)).count()
    assert tasks.count() >= 2 and tasks.agg(F.max("count")).first()[0] < 15_000


@pytest.mark.parametrize(("first", "stop"), [(0, 1), (5, 5), (3, 17), (23940, 24024), (1, 4097)])
def test_blocks_cover_a_span_once(first, stop):
    cover = blocks.covering(first, stop)
    assert [m for level, b in cover for m in range(b << level, (b + 1) << level)] == list(range(first, stop))
    assert len(cover) <= 2 * blocks.LEVELS + (stop - first) // (1 << blocks.LEVELS)


def test_month_number_counts_whole_months():
    assert blocks.month_number("2000-01-31") == 24000 and blocks.month_number("2000-02-28") == 24000
    assert blocks.month_number("2000-02-29") == 24001 and blocks.month_number("1999-12-31") == 23999


def test_any_period_equals_the_months(spark):
    rng = random.Random(6)
    rows = [(g, 1990 + m // 12, m % 12 + 1, None if rng.random() < 0.1 else rng.gauss(0.01, 0.1)) for g in (1, 2) for m in range(70) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "grp int, year int, month int, ret double")
    ends = [dt.date(1989 + y, m, 28) for y in range(0, 8) for m in (1, 6, 12)]
    periods = {f"{i}": (str(rng.choice(ends[:12])), str(rng.choice(ends[8:]))) for i in range(25)}
    got = {(r["period"], r["grp"]): r for r in blocks.period_stats(blocks.month_blocks(df, "ret"), periods).collect()}
    want = {}
    for name, (after, until) in periods.items():
        lo, hi = blocks.month_number(after), blocks.month_number(until)
        for g in (1, 2):
            own = [r for gg, y, m, r in rows if gg == g and r is not None and lo < y * 12 + m - 1 <= hi]
            if own:
                want[name, g] = own
    assert got.keys() == want.keys()
    for k, own in want.items():
        assert got[k]["n"] == len(own) and got[k]["wealth"] == pytest.approx(math.prod(1 + r for r in own))
        assert got[k]["annual_return"] == pytest.approx(statistics.mean(own) * 12)
        assert (got[k]["annual_volatility"] is None) == (len(own) < 2)
        if len(own) > 1:
            assert got[k]["annual_volatility"] == pytest.approx(statistics.stdev(own) * math.sqrt(12))
