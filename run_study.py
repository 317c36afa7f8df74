"""spark-submit entry: read the input files, run the study, write one table per result.

    spark-submit --conf spark.checkpoint.dir=<shared folder> run_study.py \\
        --months <path> --factors <path> --accounts <path> --links <path> [--macro <path>] [--extra <path>] --out <folder>
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from panelforge.plans.study import full_study, read_inputs, store_panel, write_study
from panelforge.settings import Sample
from panelforge.storage import drop_stored


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("months", "factors", "accounts", "links"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("macro", "extra"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", default="csv", help="of the input files: csv, parquet or orc")
    parser.add_argument("--out-format", default="parquet")
    parser.add_argument("--panel", help="folder of the stored security panel, by year; the inputs' years are replaced there")
    parser.add_argument("--dedupe", action="store_true", help="one account per company and fiscal year")
    parser.add_argument("--tree-partitions", type=int, default=16, help="of the trees' training rows; part of the models")
    for field in fields(Sample):
        parser.add_argument(f"--{field.name.replace('_', '-')}", default=field.default)
    args = parser.parse_args()

    spark = SparkSession.builder.appName("panelforge").getOrCreate()
    sample = Sample(**{field.name: getattr(args, field.name) for field in fields(Sample)})
    paths = {name: getattr(args, name) for name in ("months", "factors", "accounts", "links", "macro", "extra")}
    inputs = read_inputs(spark, paths, sample, args.format)
    if args.panel:
        store_panel(inputs, sample, args.panel)
    results = full_study(inputs, sample, args.dedupe, args.tree_partitions)
    write_study(results, args.out, args.out_format)
    drop_stored(spark)


if __name__ == "__main__":
    main()
