"""Column lists of the input files; types are applied by name, not by position."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from panelforge.settings import MACRO_SERIES


def _schema(**types) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in types.items()])


# Monthly security file, one row per security and month; ``ret`` and ``siccd`` may hold codes.
SECURITY_MONTH = _schema(
    permno=LongType, permco=LongType, date=StringType, shrcd=IntegerType, exchcd=IntegerType,
    siccd=StringType, prc=DoubleType, ret=StringType, vol=DoubleType, shrout=DoubleType,
)

# Monthly factor file in percent; ``date`` is yyyyMM, other lines of the file are ignored.
FACTOR_MONTH = StructType([
    StructField("Date", StringType()), StructField("Mkt-RF", StringType()), StructField("RF", StringType()),
])

# Dated links from a company id to a security id; dates are yyyyMMdd, an open end is not a date.
LINK = _schema(
    gvkey=LongType, linktype=StringType, linkprim=StringType, lpermno=LongType, lpermco=LongType,
    linkdt=StringType, linkenddt=StringType,
)

# Annual company accounts.
FUNDAMENTAL = _schema(
    gvkey=LongType, datadate=StringType, fyear=IntegerType, datafmt=StringType,
    **{item: DoubleType for item in (
        "seq ceq pstk at lt txditc itcb txdb pstkrv pstkl revt ni act lct xrd").split()},
)

# Extra annual item, joined by company and date.
FUNDAMENTAL_EXTRA = _schema(gvkey=LongType, datadate=StringType, datafmt=StringType, prba=DoubleType)

# Macro series, one column each; ``date`` is yyyy-MM-dd, a series may be daily.
MACRO = _schema(date=StringType, **{name: DoubleType for name in MACRO_SERIES})
