"""From raw documents to token files: quality, near copies, benchmark passages, mixing, token output.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is stored and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import compression_quality, decontaminate, minhash, mixing, token_files
from panelforge.storage import durable, new_path

MIN_QUALITY = 0.3
END_ID = 2


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least ``MIN_QUALITY``, learned from ``labels`` but for the held-out rows.

    Every row is judged by its own text, so equal texts go or stay together, whatever their ids; a null text counts as an empty
    one. Without labels of both classes every score is 0.5, and all rows stay. An empty table gives no rows.
    """
    model = compression_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return compression_quality.score(docs, model, name).where(F.col(name) >= MIN_QUALITY).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, 80 percent): that of the least ``doc_id``, a null id last.

    Rows are compared one by one, whatever their ids: different texts under one id stay, and copies of rows without an id
    go. Of rows with the same id that with the least hash of its text stays, of equal rows any one. A row without words is a
    copy of nothing and stays. An empty table gives no rows. All columns are kept as they are.
    """
    number = "row_number"
    while number in docs.columns:
        number += "_"
    rows = durable(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    copies = minhash.near_copies(rows.select(F.col(number).alias("doc_id"), "text"), k=5, percent=80)
    copies = copies.select(F.col("doc_id").alias("n"), "component_id")
    order = rows.select(F.col(number).alias("n"), F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), number).alias("order"))
    first = order.join(copies, "n").groupBy("component_id").agg(F.min_by("n", "order").alias(number)).select(number)
    return rows.join(durable(first, "first"), number, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of ``benchmark``, up to a fifth of whose words may be edited.

    Every row is judged by its own whole text; null and empty texts hold nothing and stay, equal rows go or stay together. With
    an empty benchmark all rows stay.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target asks; a row taken twice is there twice.

    A null source is a source of its own, the last. A row without words adds none, and is taken like the others of its
    source. An empty table gives no rows.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and per row ``doc_id, start, n_tokens, ids_crc32`` as read back from them.

    A null text is an empty one, with the end id alone. Rows with a null id come first; rows with one id lie side by side,
    each with a ``start`` of its own.
    """
    path = new_path(spark, "tokens")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    digests = durable(token_files.digest_token_files(token_files.read_token_files(spark, path)), "digests")
    return token_files.with_starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]

#: SQL has neither the compression, the hashes nor the tokenizer; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.split(" ")[0].lower().replace("/", "-"))
    return docs
