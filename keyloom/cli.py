"""python -m keyloom.cli mode=SORTED records=1m runs=3: times the sort strategies and shows the plans."""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from keyloom.operators.compare import compare, tune
from keyloom.operators.plan_table import bucket_report, plan_table, step_trace
from keyloom.plans.options import parse
from keyloom.sources.datagen import generate


def main(args: list[str]) -> None:
    options = parse(args)
    spark = SparkSession.builder.getOrCreate()
    if options.tune_records:
        mode, _ = options.cases()[0]
        best = tune(spark, mode, options.tune_records, runs=options.runs, warmups=options.warmups, warmup_records=options.warmup_records)
        options = replace(options, config=best)
        print(f"config={best.msd_bits},{best.lsd_bits},{best.tiny}")
    compare(spark, options).show(1000, truncate=False)
    for mode, n in options.cases():
        plan = plan_table(generate(spark, mode, n), "key", "value", 64 - options.config.msd_bits, not options.signed, options.config)
        print(f"{mode}, {n} rows")
        bucket_report(plan).show(100, truncate=False)
        workers = options.partitions or spark.sparkContext.defaultParallelism
        step_trace(plan, workers, options.stealing, options.work_batch or max(4, workers // 2)).show(50, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
