"""Bit descriptors: counts, OR, AND and variable bits, whole or by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import u64


def variable_bits(above: Column, below: Column, shift: int = 64) -> Column:
    """OR xor AND of the bits under shift."""
    return u64.band(above.bitwiseXOR(below), u64.low_mask(shift))


def _aggregates(key: Column) -> list[Column]:
    return [F.count(key).alias("n"), F.bit_or(key).alias("or_mask"), F.bit_and(key).alias("and_mask")]


def _finish(df: DataFrame, shift: int = 64) -> DataFrame:
    vbm = F.when(F.col("n") > 1, variable_bits(F.col("or_mask"), F.col("and_mask"), shift)).otherwise(F.lit(0).cast("long"))
    return df.withColumn("vbm", vbm).withColumn("rvb", F.bit_count("vbm").cast("long"))


def global_descriptor(df: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, or_mask, and_mask, vbm, rvb and n_null, of the whole or by group.

    Null keys are outside the masks. Partial aggregates are combined before the shuffle.
    """
    k = F.col(key).cast("long")
    agg = [*_aggregates(k), F.count(F.when(k.isNull(), 1)).alias("n_null")]
    return _finish(df.groupBy(*by).agg(*agg) if by else df.agg(*agg))


def bucket_of(key: Column, shift: int, bits: int, unsigned: bool = True) -> Column:
    return u64.digit(u64.raw_view(key, unsigned), shift, bits)


def bucket_descriptors(df: DataFrame, key: str, shift: int, bits: int = 13, unsigned: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """The plan rows: bucket, start, n, or_mask, and_mask, vbm and rvb of every bucket with rows.

    Buckets are the `bits` of the key's ordered view above shift, so there are at most
    2^bits of them (a group); start is the exclusive prefix sum of n over them.
    """
    k = F.col(key).cast("long")
    rows = df.filter(k.isNotNull()).groupBy(*by, bucket_of(k, shift, bits, unsigned).alias("bucket")).agg(*_aggregates(k))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long")
    return _finish(rows.withColumn("start", start), shift).select(*by, "bucket", "start", "n", "or_mask", "and_mask", "vbm", "rvb")


def plan_mask(plan: DataFrame) -> DataFrame:
    """OR of all buckets' variable bits, and the largest bucket."""
    return plan.agg(F.bit_or("vbm").alias("plan_vbm"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("non_empty"))
