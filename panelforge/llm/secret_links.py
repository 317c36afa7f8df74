"""Secret scans with linking: strong matches by themselves, weak ones where the parts of a credential meet."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.storage import durable

#: Kinds in the order in which spans of one start are listed; the first three are reported wherever they match.
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
_TIE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"((?i:password|passwd|secret|token|api_?key)){_TIE}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
IDENT = rf"((?i:access_?key_?id|client_?id|user_?name|user|login)){_TIE}([A-Za-z0-9_.@+-]+)"
TOKEN = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40,}={0,2}"
ENDPOINT = r"https?://[^\x20\x09-\x0D\"'<>]+"
#: Matches whose positions are summed up in one go.
RUN = 128
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_WEAK, MIN_IDENT = 12, 18, 16, 6, 3

SPAN = "array<struct<kind:string,start:bigint,end:bigint,text:string>>"


def _spans(kind: str, text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, with code point positions.

    A split at the pattern gives the text between the matches, so positions are running sums of lengths: first within
    runs of ``RUN`` matches, then over the runs, so that time grows with the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    pairs = F.zip_with(gaps, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans"))

    def add(done: Column, pair: Column) -> Column:
        begin = done["at"] + pair["gap"]
        end = begin + F.length(pair["match"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["match"].alias("text"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    def runs(pairs: Column) -> Column:
        last = F.floor(F.greatest(F.size(pairs) - 1, F.lit(0)) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(pairs, i * RUN + 1, RUN), start, add))

    def whole(runs: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("starts"))
        starts = F.aggregate(
            runs, first,
            lambda done, run: F.struct((done["at"] + run["at"]).alias("at"), F.concat(done["starts"], F.array(done["at"])).alias("starts")),
            lambda done: done["starts"],
        )
        return F.flatten(F.zip_with(runs, starts, lambda run, at: F.transform(run["spans"], lambda s: F.struct(
            s["kind"].alias("kind"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["text"].alias("text")
        ))))

    # a lambda's argument is worked out once, however often its body names it
    return F.transform(F.transform(F.array(pairs), runs), whole)[0]


def _where(possible: Column, spans: Column) -> Column:
    return F.when(possible, spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _mentions(text: Column, *parts: str) -> Column:
    """Whether a match is possible at all: a plain search that rules out most texts at little cost."""
    return reduce(or_, (text.contains(p) for p in parts))


def _value_length(pattern: str):
    return lambda span: F.length(F.regexp_extract(span["text"], pattern, 2))


def scan(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, ``version`` (a hash that tells texts of one id apart) and an array of spans per kind.

    ``short`` holds the assignments that are too short by themselves. Only built-in functions run over the texts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("lower", F.lower("text"))
    text, lower = F.col("text"), F.col("lower")
    assigned = _where(_mentions(lower, "password", "passwd", "secret", "token", "apikey", "api_key"), _spans("assign", text, ASSIGN))
    access = _where(text.contains("AKIA"), _spans("access", text, ACCESS))
    # a run that is long enough is found as a whole by either pattern
    hexes = _where(text.rlike(f"[0-9a-f]{{{MIN_HEX}}}"), _spans("hex", text, f"[0-9a-f]{{{MIN_HEX},}}"))
    idents = _where(_mentions(lower, "access", "client", "user", "login"), _spans("ident", text, IDENT))
    endpoints = _where(text.contains("://"), _spans("endpoint", text, ENDPOINT))
    tokens = _where(text.rlike(TOKEN), _spans("weak", text, TOKEN))
    value, named = _value_length(ASSIGN), _value_length(IDENT)
    found = rows.select(
        "doc_id",
        F.xxhash64("text").alias("version"),
        assigned.alias("assigned"),
        F.filter(access, lambda s: F.length(s["text"]) >= MIN_ACCESS).alias("access"),
        hexes.alias("hex"),
        F.filter(idents, lambda s: named(s) >= MIN_IDENT).alias("ident"),
        endpoints.alias("endpoint"),
        tokens.alias("tokens"),
    )
    short = F.filter("assigned", lambda s: (value(s) >= MIN_WEAK) & (value(s) < MIN_ASSIGN))
    return found.select(
        "doc_id", "version", "access", "hex", "ident", "endpoint", "tokens",
        F.filter("assigned", lambda s: value(s) >= MIN_ASSIGN).alias("assign"),
        F.transform(short, lambda s: s.withField("kind", F.lit("weak"))).alias("short"),
    )


def link(found: DataFrame, scope: int) -> DataFrame:
    """Weak candidates with their complements, as ``doc_id, version, linked``: an array of spans.

    A credential has an identifier (``ident`` or ``access``), a secret (``assign``, ``weak``) and an endpoint. Two
    spans are in one scope if at most ``scope`` code points lie between them. A weak identifier counts next to
    a secret, a weak secret next to an identifier, and an endpoint next to both.

    An interval join: every span goes to the stretches of ``scope`` code points that it meets, complements to
    those within reach too, and spans of one text and stretch are compared. A stretch holds no more spans of a
    kind than fit into it, so the work grows with the text, whatever it holds.
    """

    def part(columns: list[str], role: str) -> Column:
        spans = F.concat(*columns)
        return F.transform(spans, lambda s: F.struct(F.lit(role).alias("role"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    every = F.concat(
        part(["ident", "access"], "identifier"), part(["assign", "short", "tokens"], "secret"), part(["endpoint"], "endpoint")
    )
    some_identifier, some_secret = F.size("ident") + F.size("access") > 0, F.size("assign") + F.size("short") + F.size("tokens") > 0
    parts = found.where(some_identifier & some_secret).select("doc_id", "version", F.explode(every).alias("p")).select("doc_id", "version", "p.*")
    parts = durable(parts.distinct(), "parts")

    def stretches(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope)))

    weak = parts.where(F.col("kind").isin("ident", "weak", "endpoint"))
    weak = weak.withColumn("stretch", stretches(F.col("start"), F.col("end")))
    near = parts.select(
        F.col("doc_id").alias("of"), F.col("version").alias("at"), F.col("role").alias("complement"),
        F.col("start").alias("from"), F.col("end").alias("to"),
        stretches(F.col("start") - scope, F.col("end") + scope).alias("reach"),
    ).where(F.col("complement") != "endpoint")
    meets = (
        F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("at")) & (F.col("stretch") == F.col("reach"))
        & (F.col("role") != F.col("complement"))
        & (F.col("from") <= F.col("end") + scope) & (F.col("start") <= F.col("to") + scope)
    )
    sides = weak.join(near, meets).groupBy("doc_id", "version", "role", "kind", "start", "end").agg(
        F.bool_or(F.col("complement") == "identifier").alias("identified"), F.bool_or(F.col("complement") == "secret").alias("opened")
    )
    complete = sides.where((F.col("role") != "endpoint") | (F.col("identified") & F.col("opened")))
    span = F.struct("kind", "start", "end")
    return complete.groupBy("doc_id", "version").agg(F.collect_list(span).alias("linked"))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` in order of start, then kind."""
    rank = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Per row ``doc_id``, the spans of each strong kind, ``linked`` weak ones, and both lists as text.

    A null or empty text has no spans. Repeated rows, and texts that share an id, are each listed with their own
    spans; an empty table gives no rows; other columns are left out. Runs jobs when called.
    """
    found = durable(scan(docs), "secrets")
    linked = link(found, scope).withColumnsRenamed({"doc_id": "of", "version": "at"})
    rows = found.join(linked, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("at")), "left")

    def bare(column: str) -> Column:
        return F.transform(column, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    base = F.concat(bare("assign"), bare("access"), bare("hex"))
    weak = F.coalesce("linked", F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)"))
    return rows.select(
        "doc_id", "assign", "access", "hex", weak.alias("linked"),
        _listed(base).alias("base_spans"), _listed(F.concat(base, weak)).alias("spans"),
    )
