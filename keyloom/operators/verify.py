"""Verification of sorted records, stronger than sums: order, pairing, range and equality as multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import u64

#: Failure bits of a report.
ORDER, PAIR, RANGE, XOR, SUM, MULTISET = 1, 2, 4, 8, 16, 32
#: Fixed value that sets key hashes apart from value hashes.
SEED = 0x9E3779B97F4A7C15


def wrapped_sum(c: Column) -> Column:
    """The sum modulo 2^64 as a signed 64-bit integer, without overflow."""
    w = F.lit(str(1 << 64)).cast("decimal(38,0)")
    total = F.sum(c.cast("decimal(38,0)"))
    low = F.pmod(total, w)
    return F.when(low >= F.lit(str(1 << 63)).cast("decimal(38,0)"), low - w).otherwise(low).cast("long")


def checksums(df: DataFrame, key: str, value: str) -> DataFrame:
    """n, xor and wrapped sum of values, xor of value and record hashes, least and largest key."""
    df = u64.with_mixed(df, F.col(value), "__hv", u64.FMIX, 0)
    df = df.withColumn("__s", u64.mul(F.col(value), SEED))
    df = u64.with_mixed(df, F.col(key).bitwiseXOR(F.col("__s")), "__hr", u64.FMIX, 0)
    k = u64.ordered(F.col(key))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(value), F.lit(0)).alias("xor_value"),
        F.coalesce(wrapped_sum(F.col(value)), F.lit(0)).alias("sum_value"),
        F.coalesce(F.bit_xor("__hv"), F.lit(0)).alias("xor_value_hash"),
        F.coalesce(F.bit_xor("__hr"), F.lit(0)).alias("xor_record_hash"),
        u64.ordered(F.min(k)).alias("min_key"),
        u64.ordered(F.max(k)).alias("max_key"),
    )


def written(df: DataFrame) -> DataFrame:
    """df, evaluated once: a checkpoint where the session has a folder for it, kept on disk otherwise."""
    from pyspark import StorageLevel

    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist(StorageLevel.DISK_ONLY)


def verify_sorted(result: DataFrame, source: DataFrame, key: str, pos: str, out_pos: str = "out_pos", unsigned: bool = True, slice_bits: int = 16, generated: DataFrame | None = None) -> DataFrame:
    """One row: n, failures (bits) and the first failing position, of a sort's result.

    result has key, pos and out_pos and is evaluated once; source has key and pos. Order is
    compared inside slices of out_pos and across their ends; the multisets of (key, pos) are
    compared by counts. With generated (key and value), PAIR tells that a record isn't one of
    the generator's.
    """
    result = written(result.select(key, pos, out_pos))
    rows = result.select(u64.ordered(F.col(key), unsigned).alias("k"), F.col(pos).alias("p"), F.col(out_pos).alias("o"))
    rows = rows.withColumn("slice", F.shiftright("o", slice_bits))
    w = Window.partitionBy("slice").orderBy("o")
    rows = rows.withColumns({"bk": F.lag("k").over(w), "bp": F.lag("p").over(w), "bo": F.lag("o").over(w)})
    wrong = F.col("bk").isNotNull() & ((F.col("bk") > F.col("k")) | ((F.col("bk") == F.col("k")) & (F.col("bp") >= F.col("p"))) | (F.col("bo") + 1 != F.col("o")))
    parts = rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(wrong, F.col("o"))).alias("bad"), F.min_by(F.struct("k", "p"), "o").alias("first"), F.max_by(F.struct("k", "p"), "o").alias("last"), F.min("o").alias("lo"), F.max("o").alias("hi"))
    v = Window.partitionBy(F.lit(0)).orderBy("slice")
    edge = F.lag("last").over(v).isNotNull() & ((F.lag("last").over(v) >= F.col("first")) | (F.lag("hi").over(v) + 1 != F.col("lo")))
    order = parts.withColumn("bad", F.least("bad", F.when(edge, F.col("lo")))).agg(F.sum("n").alias("n"), F.min("bad").alias("first_bad"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sides = result.select(F.col(key).alias("k"), F.col(pos).alias("p"), F.lit(1).alias("s")).unionAll(source.select(F.col(key).alias("k"), F.col(pos).alias("p"), F.lit(-1).alias("s")))
    differ = sides.groupBy("k", "p").agg(F.sum("s").alias("d")).filter("d <> 0").agg(F.count(F.lit(1)).alias("differ"))
    a, b = (x.agg(F.coalesce(F.bit_xor(pos), F.lit(0)).alias(f"x{t}"), F.coalesce(wrapped_sum(F.col(pos)), F.lit(0)).alias(f"s{t}"), F.count(F.lit(1)).alias(f"n{t}")) for x, t in ((result, 1), (source, 2)))
    if generated is None:
        pairs = result.sparkSession.range(1).select(F.lit(0).alias("unpaired"))
    else:
        pairs = verify_pairs(result.select(F.col(key).alias("key"), F.col(pos).alias("value")), generated).agg(F.count(F.lit(1)).alias("unpaired"))
    # Five tables of one row each.
    all_in = order.crossJoin(differ).crossJoin(a).crossJoin(b).crossJoin(pairs)
    bit = lambda c, v: F.when(c, v).otherwise(0)
    fails = bit(F.col("first_bad").isNotNull(), ORDER) + bit(F.col("unpaired") > 0, PAIR) + bit((F.col("n1") > 0) & ((F.col("lo") != 0) | (F.col("hi") != F.col("n1") - 1)), RANGE) + bit(F.col("x1") != F.col("x2"), XOR) + bit(F.col("s1") != F.col("s2"), SUM) + bit((F.col("differ") > 0) | (F.col("n1") != F.col("n2")), MULTISET)
    return all_in.select(F.col("n1").alias("n"), fails.cast("long").alias("failures"), "first_bad")


def check_sorted(*args, **kwargs) -> None:
    """Raises with the failures of verify_sorted."""
    row = verify_sorted(*args, **kwargs).first()
    if row.failures:
        names = [n for n in ("ORDER", "PAIR", "RANGE", "XOR", "SUM", "MULTISET") if row.failures & globals()[n]]
        raise AssertionError(f"{', '.join(names)} failed, first at {row.first_bad}")


def verify_pairs(df: DataFrame, generated: DataFrame) -> DataFrame:
    """Records whose key isn't the generator's for their value, or whose value it doesn't have."""
    g = generated.select(F.col("key").alias("g_key"), F.col("value").alias("g_value"))
    return df.join(g, df["value"] == g["g_value"], "left").filter(F.col("g_key").isNull() | (F.col("g_key") != F.col("key"))).select("key", "value")
