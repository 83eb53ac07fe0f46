"""Sort strategies under one harness: warm-ups, timed runs, verification and statistics.

A failure is an error row with its message, never a silent gap.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from keyloom.operators import sorting, verify
from keyloom.plans.options import Options
from keyloom.plans.planner import Config, config_candidates, summary
from keyloom.sources.datagen import generate

RESULT = "mode string, records long, algorithm string, kind string, min double, median double, mean double, stddev double, max double, cv double, p95 double, p99 double, million_per_sec double, error string"

#: Rows beyond which a sort in one task isn't tried.
ONE_TASK = 50_000_000


def _adaptive(df: DataFrame, o: Options) -> DataFrame:
    sort = sorting.adaptive_sort if o.prescan else sorting.bucket_sort_positions
    return sort(df, "key", "value", not o.signed)


#: Name: (what it sorts, builder, most rows or None). Key-only sorts and record sorts are never compared.
STRATEGIES = {
    "keys": ("keys", lambda df, o: df.select("key").orderBy("key"), None),
    "total_order": ("records", lambda df, o: sorting.sort_frame(df, "key", "value", not o.signed), None),
    "no_radix": ("records", lambda df, o: sorting.sort_frame(df, "key", "value", not o.signed), None),
    "range_sorted": ("records", lambda df, o: sorting.range_sorted(df, "key", "value", o.partitions or 8, not o.signed), None),
    "positions": ("records", lambda df, o: sorting.bucket_sort_positions(df, "key", "value", not o.signed, o.config), None),
    "dispatch": ("records", lambda df, o: sorting.dispatch_sort(df, "key", "value", 64 - o.config.msd_bits, not o.signed, o.config), None),
    "adaptive": ("records", _adaptive, None),
    "one_task": ("records", lambda df, o: sorting.sort_frame(df.coalesce(1), "key", "value", not o.signed), ONE_TASK),
}
CURATED = ("total_order", "positions", "adaptive")


def selected(names: tuple[str, ...]) -> list[str]:
    """Strategies of a list of names, `curated`, `records`, `keys` or `all`."""
    out: list[str] = []
    for n in names:
        found = [k for k, (kind, _, _) in STRATEGIES.items() if n in ("all", kind, k) or (n == "curated" and k in CURATED)]
        if not found:
            raise ValueError(f"unknown algorithm {n!r}")
        out += [k for k in found if k not in out]
    return out


def _time(build) -> tuple[float, DataFrame]:
    """Seconds of building a result, which may run jobs that plan it, and of evaluating it."""
    t = time.perf_counter()
    out = build()
    out.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t, out


def compare(spark: SparkSession, options: Options) -> DataFrame:
    """One row for each mode, size and strategy; one that is too large for a strategy has only a message."""
    rows = []
    for mode, n in options.cases():
        df = generate(spark, mode, n, options.partitions or None)
        for name in selected(options.algorithms):
            kind, build, most = STRATEGIES[name]
            if most is not None and n > most:
                rows.append((mode, n, name, kind, *[None] * 9, f"skipped: more than {most} rows"))
                continue
            spark.conf.set("spark.sql.sort.enableRadixSort", str(name != "no_radix").lower())
            try:
                found = [_time(lambda: build(df, options)) for _ in range(options.warmups + options.runs)]  # noqa: B023
                times, result = [t for t, _ in found][options.warmups :], found[-1][1]
                if "out_pos" in result.columns and n:
                    verify.check_sorted(result, df, "key", "value", unsigned=not options.signed, generated=df)
                s = summary(times)
                rows.append((mode, n, name, kind, *s.values(), n / s["median"] / 1e6, None))
            except Exception as e:
                rows.append((mode, n, name, kind, *[None] * 9, f"{type(e).__name__}: {e}"[:500]))
            finally:
                spark.conf.unset("spark.sql.sort.enableRadixSort")
    return spark.createDataFrame(rows, RESULT)


def tune(spark: SparkSession, mode: str, records: int, candidates: list[Config] | None = None, runs: int = 3, warmups: int = 1, warmup_records: int = 0) -> Config:
    """The candidate with the least median time of the positions sort; ties keep the first.

    With warmup_records, the default is first run once over so many rows.
    """
    if warmup_records:
        _time(lambda: sorting.bucket_sort_positions(generate(spark, mode, warmup_records), "key", "value"))
    df, best, least = generate(spark, mode, records), None, float("inf")
    for c in candidates or config_candidates():
        times = sorted([_time(lambda: sorting.bucket_sort_positions(df, "key", "value", True, c))[0] for _ in range(runs + warmups)][warmups:])  # noqa: B023
        if times[len(times) >> 1] < least:
            best, least = c, times[len(times) >> 1]
    return best
