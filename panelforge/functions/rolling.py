"""Row-based frames over one security's history.

A history holds one row per security and period, so a window partition is bounded by the number
of periods in the calendar however many securities there are.

Sums over a frame are window frames. Variances and correlations of long frames are merged from the moments of shorter
runs of rows: a run of four times the length from four lagged ones, and a frame from at most three runs of each
length. The cost of a row then grows with the logarithm of the frame. Nothing is ever subtracted, so an extreme value
leaves no trace in frames that do not hold it, and the variance of equal values is exactly zero.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.functions.numeric import as_column, log_positive, ratio

#: How many runs make one of the next length.
BASE = 4


@dataclass(frozen=True)
class Moments:
    """Frame of the last ``rows`` rows of column ``x``, or of ``x`` and ``y`` where both are present."""

    rows: int
    x: str
    y: str | None = None

    @property
    def fields(self) -> tuple[str, ...]:
        """Count, means, and sums of squared and mixed deviations."""
        return ("n", "mx", "my", "xx", "yy", "xy") if self.y else ("n", "mx", "xx")


def history(by: str | Sequence[str] = "permno", order: str | Sequence[str] = "date") -> WindowSpec:
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*by).orderBy(*order)


def rows_back(window: WindowSpec, far: int, near: int = 0) -> WindowSpec:
    """Rows from ``far`` back to ``near`` back, both included."""
    return window.rowsBetween(-far, -near)


def enough(value: Column, observed: Column, frame: WindowSpec, min_obs: int) -> Column:
    """``value`` where at least ``min_obs`` rows of the frame are observed; 0 switches the rule off."""
    return F.when(F.count(observed).over(frame) >= min_obs, value) if min_obs else value


def compound_return(ret: Column | str, frame: WindowSpec, min_obs: int = 0) -> Column:
    """Return compounded over the frame; months at or below -100% are left out of the log sum."""
    growth = log_positive(1 + as_column(ret))
    return enough(F.exp(F.sum(growth).over(frame)) - 1, growth, frame, min_obs)


def winning_months(ret: Column | str, frame: WindowSpec) -> Column:
    """Months in the frame with a return of zero or more; a missing return counts as losing."""
    return F.sum(F.when(as_column(ret) >= 0, 1).otherwise(0)).over(frame)


def _row_state(frame: Moments) -> dict[str, str]:
    present = " AND ".join(f"`{c}` IS NOT NULL" for c in (frame.x, frame.y) if c)
    known = {"n": "1D", "mx": f"CAST(`{frame.x}` AS DOUBLE)", "my": f"CAST(`{frame.y}` AS DOUBLE)"}
    return {f: f"IF({present}, {known[f]}, 0D)" if f in known else "0D" for f in frame.fields}


def _merged(a: str, b: str, fields: Sequence[str]) -> dict[str, str]:
    """The moments of the runs ``a`` and ``b`` together, by Chan's formulas."""
    share = f"IF({a}_n + {b}_n > 0, {b}_n / ({a}_n + {b}_n), 0D)"
    gap = {c: f"({b}_m{c} - {a}_m{c})" for c in "xy"}
    made = {"n": f"{a}_n + {b}_n", **{f"m{c}": f"{a}_m{c} + {gap[c]} * {share}" for c in "xy"}}
    made |= {f: f"{a}_{f} + {b}_{f} + {gap[f[0]]} * {gap[f[1]]} * ({a}_n * {share})" for f in ("xx", "yy", "xy")}
    return {f: made[f] for f in fields}


def _merge_all(df: DataFrame, wanted: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """New runs by name, each of the runs and with the fields given; one merge of every new run at a time."""
    for i in range(max(len(parts) for parts, _ in wanted.values())):
        step = {}
        for out, (parts, fields) in wanted.items():
            if i < len(parts):
                made = _merged(out, parts[i], fields) if i else {f: f"{parts[0]}_{f}" for f in fields}
                step |= {f"{out}_{f}": F.expr(sql) for f, sql in made.items()}
        df = df.withColumns(step)
    return df


def _runs(rows: int) -> list[list[int]]:
    """By length (1, 4, 16, ...) how many rows back the runs end that together make the last ``rows`` rows."""
    if rows < 1:
        raise ValueError("a frame needs a row")
    digits, at = [], 0
    while rows:
        rows, digit = divmod(rows, BASE)
        digits.append(digit)
    found = [[] for _ in digits]
    for k in reversed(range(len(digits))):
        found[k] = [at + i * BASE**k for i in range(digits[k])]
        at += digits[k] * BASE**k
    return found


def with_moments(
    df: DataFrame, frames: Mapping[str, Moments], by: Sequence[str] = ("permno",), order: Sequence[str] = ("date",)
) -> DataFrame:
    """``df`` with the moments of each frame as a struct column of the frame's name.

    Every length of run is one lag of all frames at once; the windows have the partitioning and order of ``history``, so
    they share its shuffle and sort. Columns that begin with ``run_`` are used on the way.
    """
    over = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in by)} ORDER BY {', '.join(f'`{c}`' for c in order)})"
    kept = [f"`{c}`" for c in df.columns if c not in frames]
    plans = {name: _runs(frame.rows) for name, frame in frames.items()}
    df = df.selectExpr("*", *(f"{c} AS run_{name}_0_0_{f}" for name, frame in frames.items() for f, c in _row_state(frame).items()))
    for k in range(max(map(len, plans.values()))):
        lags, longer = [], {}
        for name, frame in frames.items():
            if k < len(plans[name]):
                offsets = set(plans[name][k])
                if k + 1 < len(plans[name]):
                    ends = [i * BASE**k for i in range(BASE)]
                    offsets |= set(ends)
                    longer[f"run_{name}_{k + 1}_0"] = [f"run_{name}_{k}_{o}" for o in ends], frame.fields
                for o in sorted(offsets - {0}):
                    lags += [f"coalesce(lag(run_{name}_{k}_0_{f}, {o}) {over}, 0D) AS run_{name}_{k}_{o}_{f}" for f in frame.fields]
        df = df.selectExpr("*", *lags) if lags else df
        df = _merge_all(df, longer) if longer else df
    whole = {
        f"run_{name}": ([f"run_{name}_{k}_{o}" for k, own in enumerate(plans[name]) for o in own], frame.fields) for name, frame in frames.items()
    }
    states = [f"struct({', '.join(f'run_{name}_{f} AS {f}' for f in frame.fields)}) AS `{name}`" for name, frame in frames.items()]
    return _merge_all(df, whole).selectExpr(*kept, *states)


def volatility(moments: str, min_obs: int = 0) -> Column:
    """Sample standard deviation of a frame; NULL for one value."""
    m = F.col(moments)
    return F.when(m["n"] >= max(2, min_obs), F.sqrt(m["xx"] / (m["n"] - 1)))


def correlation(moments: str, min_obs: int = 0) -> Column:
    """Pairwise-complete correlation of a frame; NULL for one pair or a constant side."""
    m = F.col(moments)
    return F.when(m["n"] >= max(2, min_obs), ratio(m["xy"], F.sqrt(m["xx"]) * F.sqrt(m["yy"])))
