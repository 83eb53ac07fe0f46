"""Descriptors over a stream (an extension): counts, OR and AND are commutative monoids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.descriptors import bucket_of


def stream_descriptors(stream: DataFrame, key: str, shift: int, bits: int = 13, unsigned: bool = True, time: str | None = None, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """n, or_mask and and_mask by bucket, and by event-time window with a watermark if time is named."""
    k = F.col(key).cast("long")
    by = [bucket_of(k, shift, bits, unsigned).alias("bucket")]
    if time:
        stream = stream.withWatermark(time, late)
        by.append(F.window(time, window).alias("window"))
    return stream.filter(k.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bit_or(k).alias("or_mask"), F.bit_and(k).alias("and_mask"))
