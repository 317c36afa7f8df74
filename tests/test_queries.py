"""Every registered query at the smallest scale, against its SQL where there is one."""

import glob
import os
from functools import cached_property

import duckdb
import pytest

import __spark_entry__ as entry
from checks import oracle, outputs, study
from panelforge.plans import modelling, panel
from panelforge.storage import durable

FOLDER = "/root/testdata/sf0.001"


class StoredStudy(study.Study):
    """One study for all queries, so that the panel is built once."""

    @cached_property
    def research(self):
        return durable(panel.research_panel(self.panel, self.linked), "research")


@pytest.fixture(scope="module")
def shared(spark):
    return StoredStudy(spark, FOLDER)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_registry_is_complete():
    assert set(entry.queries()) >= set(outputs.COLUMNS) == set(study.BUILDERS)
    assert set(entry.oracle_sql()) < set(entry.queries())
    without = set(study.BUILDERS) - set(entry.oracle_sql())
    assert without == {
        "tree_predict", "rf_predict", "gbt_predict", "rf_importance", "gbt_importance", "tree_metrics",
        "backtest_rf", "backtest_gbt", "strategy_compare_models", "strategy_stats_models",
    }


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    return a == b


@pytest.mark.parametrize("key", list(study.BUILDERS))
def test_query(key, shared, db):
    df = outputs.spark_output(key, study.BUILDERS[key](shared))
    names = sorted(df.columns)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert got
    if key not in oracle.BODIES:
        return
    cursor = db.execute(oracle.statement(key))
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    want = [tuple(r[i] for i in at) for r in cursor.fetchall()]
    assert len(got) == len(want)

    def order(row):
        return [(x is None, round(x, 3) if isinstance(x, float) else str(x)) for x in row]

    keyed = [i for i, n in enumerate(names) if not isinstance(next((r[i] for r in got if r[i] is not None), 0.0), float)]
    for a, b in zip(*(sorted(rows, key=lambda r: ([order(r)[i] for i in keyed], order(r))) for rows in (got, want))):
        assert all(map(same, a, b)), (a, b)


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", ["strategy_compare", "strategy_compare_models", "tree_metrics"])
def test_the_panel_is_computed_once(spark, monkeypatch, key):
    """Model rows and sorts read the stored panel; the order lines are read by its query alone."""
    stored = []

    def noting(df, label, *args, **options):
        stored.append((label, "l_suppkey" in df._jdf.queryExecution().executedPlan().toString()))
        return durable(df, label, *args, **options)

    for module in (study, modelling):
        monkeypatch.setattr(module, "durable", noting)
    study.BUILDERS[key](study.Study(spark, FOLDER))
    assert [label for label, computed in stored if computed] == ["research"]
    assert "model-rows" in [label for label, _ in stored]
