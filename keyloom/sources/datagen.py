"""Deterministic record source for the key topologies, without rows on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import u64
from keyloom.sources.modes import CLASSES, MODES, row_count


def generate(spark: SparkSession, mode: str, n: int | None = None, partitions: int | None = None) -> DataFrame:
    """(key, value) records of a mode; value is the row index."""
    spec, n = MODES[mode], row_count(mode, n)
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    df = rows.select(F.col("id").alias("value"))
    if n == 0 or spec.key is None:
        return df.select(F.lit(0).cast("long").alias("key"), "value").limit(0)
    i = F.col("value")
    if spec.mixes:
        source = {"i": i, "i,i+1": i, "i*G": u64.mul(i, u64.GOLDEN), "i^G": i.bitwiseXOR(u64.const(u64.GOLDEN))}[spec.mixes]
        df = u64.with_mixed(df, source, "m")
        if spec.mixes == "i,i+1":
            df = u64.with_mixed(df, F.col("value") + 1, "m2")
    m = F.col("m") if spec.mixes else None
    return df.select(spec.key(i, m, n).cast("long").alias("key"), "value")


def generate_sql(mode: str, n: int | None = None) -> str:
    """DuckDB SQL with the rows of generate()."""
    spec, n = MODES[mode], row_count(mode, n)
    if n == 0:
        return "SELECT 0::BIGINT AS key, 0::BIGINT AS value WHERE false"
    w = 1 << 64
    source = {"i*G": f"(i * {u64.GOLDEN}::UHUGEINT) % {w}::UHUGEINT", "i^G": f"xor(i, {u64.GOLDEN}::UHUGEINT)"}.get(spec.mixes, "i")
    steps = f"SELECT i, ({source} + {u64.GOLDEN}::UHUGEINT) % {w}::UHUGEINT AS m, (i + 1 + {u64.GOLDEN}::UHUGEINT) % {w}::UHUGEINT AS m2 FROM (SELECT range::UHUGEINT AS i FROM range({n}))"
    for shift, factor in u64.SPLITMIX:
        f = (lambda c: f"(xor({c}, {c} >> {shift}) * {factor}::UHUGEINT) % {w}::UHUGEINT") if factor else (lambda c: f"xor({c}, {c} >> {shift})")
        steps = f"SELECT i, {f('m')} AS m, {f('m2')} AS m2 FROM ({steps})"
    return f"""SELECT CASE WHEN u >= {1 << 63}::UHUGEINT THEN (u::HUGEINT - {w}::HUGEINT)::BIGINT ELSE u::BIGINT END AS key, i::BIGINT AS value
        FROM (SELECT i, CAST({spec.sql(n)} AS UHUGEINT) AS u FROM ({steps}))"""


def describe(spark: SparkSession, mode: str, n: int = 1000) -> DataFrame:
    """One row: mode, topology, what its keys are like, what a plan comes to, and of n rows the middle one's key and the varying bits in hex."""
    from keyloom.operators.descriptors import global_descriptor

    keys, plan = MODES[mode], CLASSES[MODES[mode].topology]
    df = generate(spark, mode, n)
    middle = df.agg(F.max_by("key", F.when(F.col("value") <= row_count(mode, n) // 2, F.col("value"))).alias("key"))
    bits = global_descriptor(df, "key").select("vbm")
    head = [F.lit(x).alias(c) for c, x in zip(("mode", "topology", "description", "expected"), (keys.name, keys.topology, *plan), strict=True)]
    # Tables of one row each.
    return middle.crossJoin(bits).select(*head, u64.hex16(F.col("key")).alias("example"), u64.hex16(F.coalesce("vbm", F.lit(0).cast("long"))).alias("varying"))


def catalog(spark: SparkSession) -> DataFrame:
    """The modes with their ordinal, topology, its description and expectation, and fixed row count."""
    rows = [(k, m.name, m.topology, *CLASSES[m.topology], m.rows) for k, m in enumerate(MODES.values())]
    return spark.createDataFrame(rows, "ordinal int, mode string, topology string, description string, expected string, fixed_rows int")


def catalog_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, '{m.name}', '{m.topology}', {', '.join(map(quoted, CLASSES[m.topology]))}, {'NULL' if m.rows is None else m.rows})" for k, m in enumerate(MODES.values()))
    return f"SELECT * FROM (VALUES {rows}) AS t(ordinal, mode, topology, description, expected, fixed_rows)"
