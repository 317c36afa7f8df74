"""The registered queries of the text operators: each runs one over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import (
    compression_quality,
    conversation_trie,
    decontaminate,
    divergence,
    fill_in_middle,
    interpolated_lm,
    minhash,
    mixing,
    secret_links,
    token_counts,
    token_files,
    toxicity,
    url_rules,
)
from panelforge.llm.text import text_crc
from panelforge.storage import durable, new_path

END_ID = 2
TOKEN_LIMIT = 1024
MIN_QUALITY = 0.3
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_divergence(spark: SparkSession, folder: str) -> DataFrame:
    judged = divergence.judge_quality(_table(spark, folder, "documents")).drop("lang")
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "tokens")
    docs = _table(spark, folder, "documents")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    digests = durable(token_files.digest_token_files(token_files.read_token_files(spark, path)), "digests")
    return token_files.with_starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_interpolated_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    scored = interpolated_lm.score_by_all_pairs(docs, lambda crc: crc % 7 == 2, lambda crc: crc % 7 == 3)
    held_out = text_crc() % 7 == 2
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_secret_links(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_links.find_secrets(_table(spark, folder, "documents"))
    counts = {f"n_{kind}": F.size(kind).cast("long") for kind in ("assign", "access", "hex")}
    digest = F.sha2(F.col("base_spans").cast("binary"), 256)
    return found.withColumns({**counts, "base_sha256": digest}).select("doc_id", *counts, "base_sha256", "spans")


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_copies(_table(spark, folder, "documents"), k=3, percent=85)


def op7_compression(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = compression_quality.fit(docs, _table(spark, folder, "labels"))
    scored = compression_quality.score(docs.select(F.col("doc_id").cast("long"), "text"), model)
    predicted = (F.col("quality_score") >= MIN_QUALITY).cast("int")
    held_out = text_crc() % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), predicted.alias("predicted"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    planned = mixing.plan_sizes(_table(spark, folder, "documents"))
    taken = planned["size"] * planned["copies"]
    return planned.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"))


def op9_prefix_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.prefix_counts(_table(spark, folder, "documents"), path, TOKEN_LIMIT)
    over = counted["n_tokens"] > TOKEN_LIMIT
    return counted.select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"), "chars_in_budget")


def op10_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(_table(spark, folder, "pages"), rules)


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    scored = toxicity.score(docs.select(F.col("doc_id").cast("long"), "text"), model, "score")
    held_out, predicted = text_crc() % 3 == 1, (F.col("score") >= toxicity.CUT).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "score_language")


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, folder, "documents"))
    digests = [F.sha2(c, 256).alias(f"{n}_sha256") for n, c in (("output", F.col("output")), ("restored", fill_in_middle.restored_text()))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_divergence": op1_divergence,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_files": op3_token_files,
    "op4_interpolated_lm": op4_interpolated_lm,
    "op5_secret_links": op5_secret_links,
    "op6_minhash": op6_minhash,
    "op7_compression": op7_compression,
    "op8_mixing": op8_mixing,
    "op9_prefix_counts": op9_prefix_counts,
    "op10_url_rules": op10_url_rules,
    "op11_toxicity": op11_toxicity,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_prefix_trie": op13_prefix_trie,
}

_RULE_VALUES = ", ".join(str(rule) for rule in URL_RULES)

_WORD = r"[^\x20\x09-\x0D]+"

_KEYWORDS = {
    "assign": "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]",
    "ident": "[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr]_?[Nn][Aa][Mm][Ee]"
    "|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn]",
}
_TIED = r"""["'']?\x20*[:=]\x20*["'']?"""
_SCANS = ", ".join(
    f"('{scan}', '{pattern}')"
    for scan, pattern in {
        "assign": rf"(?:{_KEYWORDS['assign']}){_TIED}[A-Za-z0-9+/_.=-]+",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
        "ident": rf"(?:{_KEYWORDS['ident']}){_TIED}[A-Za-z0-9_.@+-]+",
        "weak": "[A-Za-z0-9+/]{40,}={0,2}",
        "endpoint": r"https?://[^\x20\x09-\x0D\"''<>]+",
    }.items()
)
_COMMON = ", ".join(f"('{word}', {i})" for i, word in enumerate(divergence.COMMON_WORDS))
_CLASS_SETS = ["[^a-z]", "[^A-Z]", "[^0-9]", r"[^ \t\n\v\f\r]", "[^.,]", "[^!?;:''\"()-]"]


def _references(name: str, where: str) -> str:
    """Mean histograms by language of the documents that ``where`` keeps, drawn towards the mean of all, which has no language."""
    return f"""
        {name}_sums AS (
            SELECT lang, kind, bin, count(*) AS n, sum(1000000 * cnt // greatest(total, 1)) AS s FROM grid JOIN base USING (r) WHERE {where}
            GROUP BY lang, kind, bin
        ),
        {name}_all AS (SELECT kind, bin, sum(s) / sum(n) AS mean FROM {name}_sums GROUP BY kind, bin),
        {name}_both AS (
            SELECT lang, n, kind, bin, s + 1.0 * mean AS s FROM {name}_sums JOIN {name}_all USING (kind, bin) WHERE lang IS NOT NULL
            UNION ALL SELECT NULL, 0, kind, bin, mean FROM {name}_all
        ),
        {name} AS (SELECT lang, n, kind, bin, s / sum(s) OVER (PARTITION BY lang, kind) AS q FROM {name}_both),
        {name}_far AS (
            SELECT r, grid.kind AS kind, max(n) AS ref_n, CASE WHEN min(total) > 0 THEN sqrt(greatest(sum(
                CASE WHEN cnt > 0 THEN cnt / total * log2(cnt / total / ((cnt / total + q) / 2)) ELSE 0 END
                + CASE WHEN q > 0 THEN q * log2(q / ((cnt / greatest(total, 1) + q) / 2)) ELSE 0 END) / 2, 0)) END AS distance
            FROM grid JOIN base USING (r)
            JOIN {name} ON {name}.kind = grid.kind AND {name}.bin = grid.bin AND {name}.lang IS NOT DISTINCT FROM
                CASE WHEN base.lang IN (SELECT lang FROM {name} WHERE lang IS NOT NULL) THEN base.lang END
            GROUP BY r, grid.kind
        ),
        {name}_judged AS (
            SELECT r, max(ref_n) AS ref_n, max(distance) FILTER (kind = 'classes') AS class_distance,
                   max(distance) FILTER (kind = 'common') AS common_distance
            FROM {name}_far GROUP BY r
        )"""


_WIDER = "/ sqrt(greatest(n_words, 1)) + 2.0 / (ref_n + 1)"
_NEAR = f"""NOT base_failed AND NOT coalesce(class_distance > 0.12 + 1.2 {_WIDER}
    OR common_distance > 0.15 + 1.85 {_WIDER}, false)"""

ORACLES: dict[str, str] = {
    "op1_divergence": rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words
            FROM documents
        ),
        places AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM docs WHERE len(words) > 2),
        windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS times FROM places),
        covered AS (
            SELECT r, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY r
        ),
        counted AS (
            SELECT r, doc_id, lang, text, words, CAST(len(words) AS BIGINT) AS n_words,
                   CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
                   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines
            FROM docs
        ),
        base AS (
            SELECT c.* EXCLUDE (lines), CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words,
                   n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
            FROM counted c LEFT JOIN covered USING (r)
        ),
        class_counts AS (
            SELECT r, length(text) AS total, [{", ".join(f"length(regexp_replace(text, '{s}', '', 'g'))" for s in _CLASS_SETS)}] AS known,
                   length(regexp_replace(text, '[\x01-\x7F]', '', 'g')) AS other
            FROM base
        ),
        common(word, bin) AS (VALUES {_COMMON}),
        word_bins AS (
            SELECT r, coalesce(bin, {len(divergence.COMMON_WORDS)}) AS bin, count(*) AS cnt
            FROM (SELECT r, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM base)
            LEFT JOIN common USING (word) GROUP BY ALL
        ),
        grid AS (
            SELECT r, 'classes' AS kind, b.bin, total, CASE WHEN b.bin < 6 THEN known[b.bin + 1] WHEN b.bin = 7 THEN other
                   ELSE total - other - list_sum(known) END AS cnt
            FROM class_counts, (SELECT unnest(range(8)) AS bin) b
            UNION ALL
            SELECT base.r, 'common', b.bin, n_words, coalesce(cnt, 0)
            FROM base CROSS JOIN (SELECT unnest(range({len(divergence.COMMON_WORDS) + 1})) AS bin) b
            LEFT JOIN word_bins ON word_bins.r = base.r AND word_bins.bin = b.bin
        ),
        {_references("first_refs", "NOT base_failed")},
        near AS (SELECT r FROM base JOIN first_refs_judged USING (r) WHERE {_NEAR}),
        {_references("refs", "r IN (SELECT r FROM near)")}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               round(class_distance, 6) AS class_distance, round(common_distance, 6) AS common_distance, {_NEAR} AS kept
        FROM base LEFT JOIN refs_judged USING (r)
    """,
    "op5_secret_links": rf"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        patterns(scan, pattern) AS (VALUES {_SCANS}),
        cut AS (
            SELECT r, scan, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS gaps
            FROM (SELECT r, text, scan, pattern FROM docs CROSS JOIN patterns)
        ),
        placed AS (
            SELECT r, scan, found[i] AS match, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                   + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS BIGINT) AS start
            FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM cut)
        ),
        measured AS (
            SELECT r, scan, start, start + length(match) AS stop, length(match) AS n,
                   CASE WHEN scan IN ('assign', 'ident') THEN length(regexp_extract(match, '["'']?\x20*[:=]\x20*["'']?([^"'':\x20]*)$', 1)) END AS value,
                   scan = 'weak' AND start > 0 AND substr(text, start, 1) = '=' AS assigned
            FROM placed JOIN docs USING (r)
        ),
        spans AS (
            SELECT r, start, stop, CASE WHEN scan = 'assign' AND value < 12 THEN 'weak' ELSE scan END AS kind,
                   CASE WHEN scan IN ('ident', 'access') THEN 'identifier' WHEN scan = 'endpoint' THEN scan
                        WHEN scan <> 'hex' THEN 'secret' END AS role
            FROM measured
            WHERE CASE scan WHEN 'assign' THEN value >= 6 WHEN 'access' THEN n >= 18 WHEN 'hex' THEN n >= 16
                       WHEN 'ident' THEN value >= 3 WHEN 'weak' THEN NOT assigned ELSE true END
        ),
        near AS (
            SELECT a.r, a.start, a.stop, a.kind, a.role, bool_or(b.role = 'identifier') AS identified, bool_or(b.role = 'secret') AS opened
            FROM spans a JOIN spans b ON a.r = b.r AND b.start <= a.stop + 200 AND a.start <= b.stop + 200
            WHERE a.kind IN ('ident', 'weak', 'endpoint') AND b.role IN ('identifier', 'secret') AND a.role <> b.role
            GROUP BY ALL
        ),
        listed AS (
            SELECT r, start, stop, kind FROM spans WHERE kind IN ('assign', 'access', 'hex')
            UNION ALL SELECT DISTINCT r, start, stop, kind FROM near WHERE role <> 'endpoint' OR (identified AND opened)
        ),
        named AS (
            SELECT r, kind, kind || ':' || start || ':' || stop AS span, start, stop,
                   list_position(['assign', 'access', 'hex', 'ident', 'weak', 'endpoint'], kind) AS place
            FROM listed
        )
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex,
               sha256(coalesce(string_agg(span, ',' ORDER BY start, place, stop) FILTER (place <= 3), '')) AS base_sha256,
               coalesce(string_agg(span, ',' ORDER BY start, place, stop), '') AS spans
        FROM docs LEFT JOIN named USING (r) GROUP BY r, doc_id
    """,
    "op8_mixing": rf"""
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size FROM documents
        ),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
            FROM sized GROUP BY source
        ),
        -- each round shares what is left among the sources that are not full, and fixes those that overflow
        rounds AS (
            SELECT 0 AS round, source, source_size, weight, false AS filled,
                   (SELECT 1.5 * sum(source_size) / sum(weight) FROM sources) AS level FROM sources
            UNION ALL
            SELECT round + 1, source, source_size, weight, filled OR level * weight >= 2 * source_size,
                   (1.5 * sum(source_size) OVER () - coalesce(sum(CASE WHEN filled OR level * weight >= 2 * source_size THEN 2 * source_size END) OVER (), 0))
                   / sum(CASE WHEN filled OR level * weight >= 2 * source_size THEN 0 ELSE weight END) OVER ()
            FROM rounds WHERE round < 40
        ),
        targets AS (
            SELECT source, source_size, CAST(CASE WHEN filled THEN 2 * source_size ELSE level * weight END AS DOUBLE) AS target
            FROM rounds WHERE round = 40
        ),
        ranked AS (
            SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each,
                   row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) - 1 AS rank,
                   CAST('0x' || substr(md5('1:' || coalesce(s.source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS shift
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(size * least(floor(each * (rank + 1) + shift) - floor(each * rank + shift), ceil(each)) AS BIGINT) AS taken
        FROM ranked
    """,
    "op10_url_rules": f"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_VALUES}),
        cut AS (
            SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail
            FROM pages
        ),
        parsed AS (
            SELECT row_number() OVER () AS n, page_id,
                   translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ),
        fits AS (
            SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
            FROM parsed JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY n
        )
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
        FROM parsed LEFT JOIN fits USING (n)
    """,
    "op12_fill_in_middle": """
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                   [CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h
            FROM documents
        ),
        cut AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ),
        parts AS (SELECT *, left(text, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM parts
    """,
    "op13_prefix_trie": """
        WITH said AS (
            SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
                   sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS pos FROM said),
        -- the checksum takes a byte (a number below 256), then eight shifts (each -1)
        bits AS (
            SELECT conv_id, flatten([[ascii(d), -1, -1, -1, -1, -1, -1, -1, -1] FOR d IN string_split(CAST(conv_id AS VARCHAR), '')]) AS steps
            FROM (SELECT DISTINCT conv_id FROM said)
        ),
        convs AS (
            SELECT conv_id, conv_id - conv_id % 5 AS of, xor(list_reduce(list_transform(steps, lambda x: CAST(x AS BIGINT)), lambda c, x:
                   CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
            FROM bits
        ),
        rebuilt AS (
            SELECT c.conv_id, 0 AS part, pos, said, bytes FROM convs c JOIN turns t ON t.conv_id = c.of AND t.pos <= c.h
            UNION ALL SELECT c.conv_id, 1, pos, said, bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
        ),
        sequences AS (
            SELECT conv_id, coalesce(list(said ORDER BY part, pos) FILTER (said IS NOT NULL), []) AS path,
                   coalesce(list(bytes ORDER BY part, pos) FILTER (said IS NOT NULL), []) AS sizes
            FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
        ),
        paths AS (
            SELECT conv_id, d, array_to_string(path[1:d], ',') AS key, d = len(path) AS stops, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes,
                   CASE WHEN d > 0 THEN array_to_string(path[1:d - 1], ',') END AS parent
            FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM sequences)
        ),
        nodes AS (
            SELECT key, d AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256
            FROM paths GROUP BY key, d
        ),
        children AS (SELECT parent AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key, depth)),
        above AS (
            SELECT array_to_string(string_split(key, ',')[1:top], ',') AS key, top AS depth, CAST(n_children = 0 AS BIGINT) AS leaf, saved
            FROM (SELECT *, unnest(range(0, depth + 1)) AS top FROM counted)
        ),
        subtrees AS (SELECT key, depth, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY ALL)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM counted n JOIN subtrees USING (key, depth) LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.parent AND p.depth = n.depth - 1
    """,
}
