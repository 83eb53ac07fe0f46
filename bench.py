"""Headline queries of the ordering engine, timed; prints one JSON line.

Times are the median of BENCH_RUNS runs after a warm-up, each of which builds its plan anew
and writes to Spark's noop sink; the least are given beside them.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from keyloom import queries as K
from keyloom.operators import sorting
from keyloom.plans.planner import summary
from keyloom.sources import datagen

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
RECORDS = int(os.environ.get("BENCH_RECORDS", "1000000"))
MODES = ("RANDOM", "LOW_BITS_ONLY", "HIGH_BITS_ONLY", "DUPLICATES", "ZIPFIANISH", "SPARSE_ENTROPY_EXPLOSION")


def cases(spark: SparkSession) -> dict:
    names = ["global_descriptor", "bucket_descriptors", "order_scan_global", "sort_positions_unsigned", "bucket_sort_positions", "adaptive_sort", "dispatch_sort", "tuple_counting_sort", "bucket_reverse_positions", "heavy_keys_exact", "dominant_core_sort", "verify_sorted", "checksums", "bucket_plan"]
    out = {n: (lambda n=n: K.queries()[n](spark, DIR)) for n in names}
    out["sort_key_only"] = lambda: K.table(spark, DIR, "events").select("user_id").orderBy("user_id")
    out["sort_total_order"] = lambda: sorting.sort_frame(K.table(spark, DIR, "events"), "user_id", "event_id")
    for m in MODES:
        out[f"records_{m.lower()}"] = lambda m=m: sorting.sort_frame(datagen.generate(spark, m, RECORDS), "key", "value")
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, least, rates = {}, {}, {}
    for name, make in cases(spark).items():
        times = []
        for k in range(RUNS + 1):
            t = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            if k:
                times.append(time.perf_counter() - t)
        s = summary(times)
        seconds[name], least[name] = round(s["median"], 4), round(s["min"], 4)
        if name.startswith("records_"):
            rates[name] = round(RECORDS / s["median"] / 1e6, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "keyloom_total", "value": total, "unit": "sec", "queries": seconds, "sf": DIR.rsplit("/sf", 1)[-1], "least": least, "million_records_per_sec": rates, "cpus": int(CPUS), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
