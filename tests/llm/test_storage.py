"""What stored tables leave on the disk."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from panelforge import storage
from panelforge.llm import interpolated_lm
from tests.llm.conftest import prose


def stored(spark):
    folder = Path(storage.shared_folder(spark), "panelforge", spark.sparkContext.applicationId)
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(storage.CLEANUP)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    made = storage.durable(counts, "counts")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(storage.CLEANUP) == setting
    assert made.count() == 7 and counts.count() == 7  # the table and what it came from can still be read


def test_released_tables_are_gone(spark):
    first, second = (storage.durable(spark.range(n), "numbers") for n in (3, 4))
    there = stored(spark)
    storage.release(first)
    assert len(there - stored(spark)) == 1 and second.count() == 4


def test_language_model_keeps_only_what_its_scores_read(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, prose(rng, 50)) for i in range(40)], "doc_id long, text string")
    before = stored(spark)
    scored = interpolated_lm.score_by_all_pairs(docs, lambda crc: crc % 7 == 2, lambda crc: crc % 7 == 3, rounds=2)
    assert {name.split("-")[0] for name in stored(spark) - before} <= {"counted", "left"}
    assert scored.count() == 40
