"""Order classes of keys along a position column.

A scan works on slices of positions: inside a slice neighbours are compared, and the slices'
first and last keys are then compared along their order. No task sees more than a slice or
the list of slices of one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import u64

SLICE_BITS = 16


def slice_summaries(df: DataFrame, key: str, pos: str, unsigned: bool = True, by: tuple[str, ...] = (), slice_bits: int = SLICE_BITS) -> DataFrame:
    """First and last key (ordered view) and both directions of each slice of positions."""
    rows = df.filter(F.col(key).isNotNull()).select(*by, u64.ordered(F.col(key).cast("long"), unsigned).alias("k"), F.col(pos).alias("p"), F.shiftright(pos, slice_bits).alias("slice"))
    before = F.lag("k").over(Window.partitionBy(*by, "slice").orderBy("p"))
    rows = rows.withColumns({"up": before.isNull() | (before <= F.col("k")), "down": before.isNull() | (before >= F.col("k")), "fall": before.isNull() | (before > F.col("k"))})
    both = [F.bool_and(c).alias(c) for c in ("up", "down", "fall")]
    return rows.groupBy(*by, "slice").agg(F.count(F.lit(1)).alias("n"), F.min_by("k", "p").alias("first_key"), F.max_by("k", "p").alias("last_key"), *both)


def order_scan(df: DataFrame, key: str, pos: str, unsigned: bool = True, by: tuple[str, ...] = (), slice_bits: int = SLICE_BITS) -> DataFrame:
    """n, ascending, descending, falling (descending without ties) and order_class, of the whole or by group."""
    parts = slice_summaries(df, key, pos, unsigned, by, slice_bits)
    along = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("slice")
    last = F.lag("last_key").over(along)
    first = F.col("first_key")
    parts = parts.withColumns({"up": F.col("up") & (last.isNull() | (last <= first)), "down": F.col("down") & (last.isNull() | (last >= first)), "fall": F.col("fall") & (last.isNull() | (last > first))})
    agg = [F.sum("n").alias("n"), F.bool_and("up").alias("ascending"), F.bool_and("down").alias("descending"), F.bool_and("fall").alias("falling")]
    out = parts.groupBy(*by).agg(*agg) if by else parts.agg(*agg)
    kind = F.when(F.col("ascending"), "ASCENDING").when(F.col("descending"), "DESCENDING").otherwise("MIXED")
    return out.withColumn("order_class", kind)


def ranked(rows: DataFrame, groups: list[str], pos: str, slice_bits: int = SLICE_BITS) -> DataFrame:
    """rows with `rank`, from 0, along pos in each group, the group's size group_n and its start group_start.

    Groups follow each other in the order of their columns, which are never null. Ranks come
    from counts of slices of positions, and ranks inside: however many rows a group has, no
    task ranks more than a slice.
    """
    rows = rows.withColumn("__slice", F.shiftright(pos, slice_bits))
    counts = rows.groupBy(*groups, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    along = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    parts = counts.select(*groups, "__slice", before(along.orderBy("__slice")).alias("__before"))
    if groups:
        sizes = counts.groupBy(*groups).agg(F.sum("__n").alias("__n"))
        starts = sizes.select(*groups, F.col("__n").alias("group_n"), before(Window.partitionBy(F.lit(0)).orderBy(*groups)).alias("group_start"))
        parts = parts.join(starts, groups)
    inside = F.row_number().over(Window.partitionBy(*groups, "__slice").orderBy(pos))
    ranked = rows.withColumn("__in", inside).join(parts, [*groups, "__slice"]).withColumn("rank", (F.col("__before") + F.col("__in") - 1).cast("long"))
    return ranked.drop("__slice", "__in", "__before")


def order_probe(df: DataFrame, key: str, pos: str, n: int, unsigned: bool = True, head: int = 2048, samples: int = 1024) -> DataFrame:
    """The order class of the first rows and of a strided sample, a cheap disproof of order."""
    step = max(1, n // samples)
    rows = df.filter((F.col(pos) < head) | (F.col(pos) % step == 0))
    return order_scan(rows, key, pos, unsigned).select("order_class", "n")


def slice_boundaries(df: DataFrame, key: str, pos: str, unsigned: bool = True, slice_bits: int = 10) -> DataFrame:
    """Each slice with whether its first key is not below the last of the slice before."""
    parts = slice_summaries(df, key, pos, unsigned, (), slice_bits)
    last = F.lag("last_key").over(Window.partitionBy(F.lit(0)).orderBy("slice"))
    return parts.select("slice", "n", (last.isNull() | (last <= F.col("first_key"))).alias("boundary_ok"), F.col("up").alias("ascending"))
