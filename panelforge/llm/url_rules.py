"""Allow and block rules on URLs, found by short hash prefixes of host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a digest that are joined on; the full digest is compared afterwards.
PREFIX_BYTES = 4


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, path), 256))


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, PREFIX_BYTES)


def index_rules(rules: DataFrame) -> DataFrame:
    """Rules ``host, path, verdict`` with their digest. Rows with a null are left out, repeated rules count once.

    If a host and path are both allowed and blocked, ``block`` holds. A path starts with ``/``, so that no two
    rules share an expression; others are left out as they fit no URL.
    """
    whole = rules.select("host", "path", "verdict").dropna().where(F.col("path").startswith("/"))
    one = whole.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    digest = _digest(F.col("host"), F.col("path"))
    return one.select(F.concat("host", "path").alias("rule"), "verdict", F.length("path").alias("path_length"), digest.alias("digest"))


def match_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct ``url`` that a rule fits, ``url, rule, rule_verdict`` of the longest.

    A URL gives an expression for its host and each parent domain, with each prefix of its path whose length
    some rule has: as many as labels times those lengths, whatever the number of rules. Expressions meet rules
    on ``PREFIX_BYTES`` bytes of their digests, and a pair counts if the whole digests agree. Longest is the
    rule's text, then its host. A URL met often is expanded once.
    """
    index = index_rules(rules)
    lengths = index.agg(F.sort_array(F.collect_set("path_length"))).scalar()
    once = urls.select("url").where(F.col("url").isNotNull()).distinct()
    parsed = once.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffix = F.concat_ws(".", F.slice(F.col("labels"), F.col("first") + 1, F.size("labels")))
    hosts = (
        parsed.withColumn("labels", labels)
        .withColumn("first", F.explode(F.sequence(F.lit(0), F.size("labels") - 1)))
        .select("url", "path", suffix.alias("suffix"))
    )
    expressions = (
        hosts.withColumn("lengths", lengths)
        .withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
        .select("url", _digest(F.col("suffix"), F.expr("substring(path, 1, n)")).alias("digest"))
    )
    met = expressions.withColumn("short", _short(F.col("digest"))).join(
        index.withColumn("short", _short(F.col("digest"))).withColumnRenamed("digest", "rule_digest"), "short"
    )
    order = F.struct(F.length("rule"), F.length("rule") - F.col("path_length"), "rule", "verdict")
    best = met.where(F.col("digest") == F.col("rule_digest")).groupBy("url").agg(F.max(order).alias("best"))
    return best.select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages``; where no rule fits, ``rule`` is null and
    ``verdict`` is ``default``.

    A null URL or one without ``://`` has an empty host and path and fits no rule (its only expression, the
    empty one, starts with no ``/``). Rows are kept as they are, repeated ones too.
    """
    found = match_urls(pages, rules)
    rows = pages.select("page_id", "url").join(found, "url", "left")
    return rows.select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        "rule",
        F.coalesce("rule_verdict", F.lit(default)).alias("verdict"),
    )
