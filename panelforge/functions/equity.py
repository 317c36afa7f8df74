"""Column rules of the equity data model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.numeric import as_column

# Codes that stand for a missing return.
RETURN_SENTINELS = ("-99", "-88", "-77", "-66", "-55", "-44", "B", "C")

# Lower bound of the industry code -> division. The last bound is exclusive, all
# others inclusive; a missing code or one below 1000 gets the default. Labels keep their spelling.
DEFAULT_DIVISION = "Argriculture"
DIVISIONS = [
    (1000, "Mining"),
    (1500, "Construction"),
    (2000, "Manufacturing"),
    (4000, "Transportation"),
    (5000, "Wholesale"),
    (5200, "Retail"),
    (6000, "Finance"),
    (7000, "Services"),
    (9000, "Public_Admin"),
]


def parsed_return(raw: Column | str, sentinels: Sequence[str] = RETURN_SENTINELS) -> Column:
    """Return as a number; sentinels and unparsable text become NULL."""
    raw = as_column(raw)
    return F.when(~raw.isin(list(sentinels)), raw.try_cast("double"))


def division(code: Column | str) -> Column:
    """Industry division of a four-digit code."""
    code = as_column(code)
    exclusive = DIVISIONS[-1][0]

    def step(label: Column, rung: tuple[int, str]) -> Column:
        bound, name = rung
        inside = code > bound if bound == exclusive else code >= bound
        return F.when(inside, F.lit(name)).otherwise(label)

    return reduce(step, DIVISIONS, F.lit(DEFAULT_DIVISION))


def shareholder_equity() -> Column:
    return F.coalesce(F.col("seq"), F.col("ceq") + F.col("pstk"), F.col("at") - F.col("lt"))


def deferred_tax() -> Column:
    return F.coalesce(F.col("txditc"), F.col("itcb") + F.col("txdb"), F.col("itcb"), F.col("txdb"))


def preferred_stock() -> Column:
    return F.coalesce(F.col("pstkrv"), F.col("pstkl"), F.col("pstk"))
