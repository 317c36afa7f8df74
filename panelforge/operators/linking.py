"""Dated links between companies and securities, and the joins they carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_links(
    links: DataFrame, linktype: Sequence[str] = ("LU", "LC"), linkprim: Sequence[str] = ("P", "C")
) -> DataFrame:
    return links.where(F.col("linktype").isin(list(linktype)) & F.col("linkprim").isin(list(linkprim)))


def dated_links(links: DataFrame, as_of: str, fmt: str = "yyyyMMdd") -> DataFrame:
    """Links with real dates; an end that is no date is open and becomes ``as_of``."""

    def parsed(column: str):
        return F.try_to_date(F.col(column).cast("string"), fmt)

    return links.withColumns(
        {"linkdt": parsed("linkdt"), "linkenddt": F.coalesce(parsed("linkenddt"), F.lit(as_of).cast("date"))}
    )


def link_fundamentals(accounts: DataFrame, links: DataFrame, as_of: str, datafmt: str = "STD") -> DataFrame:
    """Accounts in the standard format with every valid link that covers their date.

    One inner join on the company with the interval as a second condition. The link table grows
    with the companies, so no broadcast is forced.
    """
    linked = dated_links(valid_links(links), as_of)
    a, k = accounts.where(F.col("datafmt") == datafmt).alias("a"), linked.alias("k")
    covered = (
        (F.col("a.gvkey") == F.col("k.gvkey"))
        & (F.col("a.datadate") >= F.col("k.linkdt"))
        & (F.col("a.datadate") <= F.col("k.linkenddt"))
    )
    extra = [f"k.{c}" for c in linked.columns if c not in accounts.columns]
    return a.join(k, covered).select("a.*", *extra)


def join_fundamental_extra(accounts: DataFrame, extra: DataFrame, datafmt: str = "STD") -> DataFrame:
    """Accounts with the extra item of the same company and date, where there is one."""
    extra = extra.where(F.col("datafmt") == datafmt).drop("datafmt")
    return accounts.join(extra, ["gvkey", "datadate"], "left")


def latest_per_key(accounts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One account per key: the latest date, then the lowest company and security, then the latest link.

    An aggregate, so each task keeps one candidate per key before the shuffle.
    """
    rest = [c for c in accounts.columns if c not in keys]
    link = [c for c in ("linkdt", "linktype", "linkprim") if c in accounts.columns]
    newest = F.max_by(F.struct(*rest), F.struct("datadate", -F.col("gvkey"), -F.col("lpermno"), *link))
    return accounts.groupBy(*keys).agg(newest.alias("row")).select(*keys, "row.*")


def join_fundamentals(panel: DataFrame, accounts: DataFrame, dedupe: bool = False) -> DataFrame:
    """Accounts of the aligned fiscal year of the security's company.

    Several companies may share the key, then the month repeats once per company. ``dedupe`` keeps
    one account per key; every month of a key would pick the same one, so the choice is made
    before the join, which then keeps the number of panel rows.
    """
    keys = ["lpermco", "fyear"]
    accounts = accounts.select(*[c for c in accounts.columns if c in keys or c not in panel.columns])
    if dedupe:
        accounts = latest_per_key(accounts, keys)
    return panel.join(accounts.withColumnRenamed("lpermco", "permco"), ["permco", "fyear"], "left")
