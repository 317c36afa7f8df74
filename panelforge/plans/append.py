"""New months appended to a panel: every signal from a small state, without reading the past again.

The state holds what the windows can still reach: a security's last universe months, and its latest row before the universe
filter, which the lagged price looks at. Its size goes with the securities, not with the calendar.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import cleaning, signals
from panelforge.plans.panel import clean_months, signal_months, universe_months
from panelforge.settings import Sample
from panelforge.storage import durable

#: The longest reach of a signal: the previous month's beta, whose correlation looks at 60 rows.
REACH = 60
APPENDED = "is_appended"


@dataclass(frozen=True)
class State:
    """What later months need of the earlier ones."""

    latest: DataFrame  # the latest raw row of each security, with a real date
    months: DataFrame  # the last ``REACH`` universe months of each security

    def write(self, path: str) -> None:
        """Keep the state for a later session. A state that was read from ``path`` must go to another one."""
        self.latest.write.mode("overwrite").parquet(f"{path}/latest")
        self.months.write.mode("overwrite").parquet(f"{path}/months")


def read_state(spark: SparkSession, path: str) -> State:
    return State(spark.read.parquet(f"{path}/latest"), spark.read.parquet(f"{path}/months"))


def _dated(raw: DataFrame, fmt: str | None) -> DataFrame:
    return cleaning.identified(cleaning.with_calendar(raw, fmt=fmt))


def _kept(rows: DataFrame, months: DataFrame) -> State:
    """The stored state after ``rows`` (raw, dated) and ``months``; the latest row is found by an aggregate."""
    columns = [c for c in rows.columns if c != "permno"]
    latest = rows.groupBy("permno").agg(F.max_by(F.struct(*columns), "date").alias("row")).select("row.*", "permno")
    newest = Window.partitionBy("permno").orderBy(F.col("date").desc())
    last = months.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= REACH).drop("place")
    return State(durable(latest.select(*rows.columns), "latest"), durable(last, "months"))


def first_state(raw: DataFrame, sample: Sample, fmt: str | None = None) -> State:
    """The state after all months of ``raw``. Runs jobs when called."""
    return _kept(_dated(raw, fmt), universe_months(clean_months(raw, fmt), sample))


def append_months(
    state: State, raw: DataFrame, factors: DataFrame | None, sample: Sample, fmt: str | None = None, weights: bool = True
) -> tuple[DataFrame, State]:
    """The rows that ``security_panel`` has for the months of ``raw``, and the state after them. Runs jobs when called.

    ``raw`` holds any number of whole months after those of the state, with the columns it had then. Rows that are not later
    than the security's latest are left out: a restated past is computed anew (and kept by ``panel_store.replace_years``).
    Rows without an id or date are left out as everywhere. New securities start without a past; those without a new month
    stay in the state, so that they may return. Only the state, ``raw`` and ``factors`` are read; state and rows share one
    shuffle by security.
    """
    known = F.max(F.when(~F.col(APPENDED), F.col("date"))).over(Window.partitionBy("permno"))
    rows = state.latest.withColumn(APPENDED, F.lit(False)).unionByName(
        _dated(raw, fmt).select(*state.latest.columns).withColumn(APPENDED, F.lit(True))
    )
    rows = rows.withColumn("known_until", known).where(~F.col(APPENDED) | F.col("known_until").isNull() | (F.col("date") > F.col("known_until")))
    rows = durable(rows.drop("known_until"), "appended")
    fresh = universe_months(clean_months(rows).where(APPENDED), sample)
    months = state.months.withColumn(APPENDED, F.lit(False)).unionByName(durable(fresh, "fresh"))
    found = signal_months(months, factors).where(APPENDED).drop(APPENDED)
    panel = cleaning.require(signals.value_weights(found) if weights else found, ["ret"])
    return panel, _kept(rows.drop(APPENDED), months.drop(APPENDED))
