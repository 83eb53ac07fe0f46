"""Sorting as explicit output positions.

A row's position is its bucket's start plus its rank in the bucket. The window that names
the buckets is laid over the highest bits that vary at all; buckets above a share of the
rows are split by the next bits that vary in them, again and again, and buckets of equal keys
by position, so that no window partition grows with a hot prefix or key. Only plan rows reach
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import u64
from keyloom.operators.descriptors import bucket_descriptors, global_descriptor
from keyloom.operators.order import order_scan, ranked
from keyloom.plans.planner import Config

#: Rows that a bucket may have whatever the total, and parts of the total beyond which it is split.
LEAST, SHARE = 65_536, 256


def sort_frame(df: DataFrame, key: str, pos: str, unsigned: bool = True) -> DataFrame:
    """The rows in total order (key, position): a range exchange and external sorts."""
    return df.orderBy(u64.ordered(F.col(key), unsigned), F.col(pos))


def range_sorted(df: DataFrame, key: str, pos: str, partitions: int, unsigned: bool = True) -> DataFrame:
    """The same order as sorted range partitions."""
    k = u64.ordered(F.col(key), unsigned)
    return df.repartitionByRange(partitions, k, F.col(pos)).sortWithinPartitions(k, F.col(pos))


def scatter(df: DataFrame, key: str, plan: DataFrame, shift: int, bits: int, partitions: int, unsigned: bool = True) -> DataFrame:
    """Rows dealt to contiguous, balanced partitions of whole buckets by the plan's starts."""
    total = plan.agg(F.sum("n")).first()[0] or 1
    place = plan.select("bucket", F.floor(F.col("start") * partitions / F.lit(total)).cast("int").alias("to"))
    rows = df.withColumn("bucket", u64.digit(u64.raw_view(F.col(key), unsigned), shift, bits))
    # At most 2^bits plan rows.
    return rows.join(F.broadcast(place), "bucket").repartitionById(partitions, F.col("to")).drop("to")


def _split_levels(df: DataFrame, view: Column, key: str, pos: str, cfg: Config, unsigned: bool, vbm: int, n: int) -> tuple[DataFrame, list[str]]:
    """df with bucket columns b0, b1, ... that follow the total order of (key, pos).

    vbm and n are the keys' variable bits and number. A group over the limit is split by its
    highest varying bits, or, if its keys are equal, by its range of positions, until none is.
    """
    shift = max(0, vbm.bit_length() - cfg.msd_bits)
    limit, zero = max(LEAST, n // SHARE), F.lit(0).cast("long")
    rows, levels = df.withColumn("b0", u64.digit(view, shift, cfg.msd_bits)), ["b0"]
    within = rows
    spark = df.sparkSession
    while True:
        sizes = within.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), F.bit_or(key).alias("o"), F.bit_and(key).alias("a"), F.min(pos).alias("lo"), F.max(pos).alias("hi"))
        splits = []
        for g in sizes.filter((F.col("n") > limit) & ((F.col("o") != F.col("a")) | (F.col("lo") < F.col("hi")))).collect():  # fewer than SHARE rows
            mask = (g.o ^ g.a) & u64.MASK64
            at = tuple(g[b] for b in levels)
            if mask:
                bits = min(cfg.msd_bits, mask.bit_length())
                splits.append((*at, mask.bit_length() - bits, u64.low_mask(bits), None, None))
            else:
                splits.append((*at, None, None, g.lo, max(1, -(-(g.hi - g.lo + 1) // (g.n // limit + 1)))))
        if not splits:
            return rows, levels
        named = ", ".join(f"{b} long" for b in levels)
        table = F.broadcast(spark.createDataFrame(splits, f"{named}, __down int, __mask long, __lo long, __step long"))
        digit = F.call_function("shiftrightunsigned", view, F.col("__down")).bitwiseAND(F.col("__mask"))
        part = F.floor((F.col(pos) - F.col("__lo")) / F.col("__step")).cast("long")
        new = f"b{len(levels)}"
        rows = rows.join(table, levels, "left").withColumn(new, F.coalesce(digit, part, zero)).withColumn("__split", F.col("__down").isNotNull() | F.col("__lo").isNotNull())
        within = rows.filter("__split")
        rows, within = (x.drop("__down", "__mask", "__lo", "__step", "__split") for x in (rows, within))
        levels = [*levels, new]


def _starts(counts: DataFrame, levels: list[str]) -> DataFrame:
    """levels and bucket_start of counts (levels, bucket_n), one row a bucket."""
    before = F.sum("bucket_n").over(Window.partitionBy(F.lit(0)).orderBy(*levels).rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*levels, F.coalesce(before, F.lit(0)).alias("bucket_start"))


def bucket_sort_positions(df: DataFrame, key: str, pos: str, unsigned: bool = True, cfg: Config = Config()) -> DataFrame:
    """df with out_pos: start of the row's bucket plus its rank there.

    Rows with a null key come last, by position. Ties of (key, pos) are ranked arbitrarily.
    """
    g = global_descriptor(df, key).first()
    known = df.filter(F.col(key).isNotNull()) if g.n_null else df
    rows, levels = _split_levels(known, u64.raw_view(F.col(key), unsigned), key, pos, cfg, unsigned, (g.vbm or 0) & u64.MASK64, g.n)
    # The plan has at most 2^13 buckets and as many children for each of SHARE large ones a level.
    starts = _starts(rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("bucket_n")), levels)
    rank = F.row_number().over(Window.partitionBy(*levels).orderBy(u64.ordered(F.col(key), unsigned), F.col(pos)))
    out = rows.withColumn("bucket_rank", rank).join(starts, levels).withColumn("out_pos", (F.col("bucket_start") + F.col("bucket_rank") - 1).cast("long"))
    out = out.select(*df.columns, "out_pos")
    if not g.n_null:
        return out
    rest = ranked(df.filter(F.col(key).isNull()), [], pos)
    return out.unionByName(rest.withColumn("out_pos", F.col("rank") + F.lit(g.n)).select(*df.columns, "out_pos"))


def dispatch_sort(df: DataFrame, key: str, pos: str, shift: int, unsigned: bool = True, cfg: Config = Config()) -> DataFrame:
    """df with route and out_pos: the plan of its buckets, carried out route by route.

    Rows of a `done` bucket keep their order; those of a bucket that falls without ties are
    reversed; `tuple-direct` counts the values of the bucket's variable bits; the others are
    ranked by key. Buckets with a local split are first dealt to its children. Null keys are
    left out. A done, reversed or counted bucket may hold all rows: their ranks come from
    slices of positions.
    """
    from keyloom.operators.plan_table import plan_table

    plan = plan_table(df, key, pos, shift, unsigned, cfg)
    # At most 2^msd_bits rows.
    steps = F.broadcast(plan.select("bucket", "start", F.col("n").alias("__n"), F.col("vbm").alias("__vbm"), "route", "falling", "local_shift", "local_bits"))
    view = u64.raw_view(F.col(key).cast("long"), unsigned)
    rows = df.filter(F.col(key).isNotNull()).withColumn("bucket", u64.digit(view, shift, cfg.msd_bits)).join(steps, "bucket")
    zero = F.lit(0).cast("long")
    turned, counted = (F.col("route") == "reverse") & F.col("falling"), F.col("route") == "tuple-direct"
    # A bucket has one mask, under which its keys have the order of their packed bits.
    values = view.bitwiseAND(F.col("__vbm"))
    child = F.when(F.col("local_shift") >= 0, F.call_function("shiftrightunsigned", view, F.greatest("local_shift", F.lit(0))).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("local_bits")) - 1)).otherwise(zero)
    rows = rows.withColumns({"__value": F.when(counted, values).otherwise(child), "__by": F.when((F.col("route") == "done") | turned | counted, F.lit(True)).otherwise(F.lit(False))})
    groups = ["bucket", "__value"]
    starts = _starts(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("bucket_n")), groups)
    along = ranked(rows.filter("__by"), groups, pos).drop("group_n", "group_start")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(u64.ordered(F.col(key), unsigned), F.col(pos))) - 1
    sorted_rows = rows.filter(~F.col("__by")).withColumn("rank", rank.cast("long"))
    out = along.unionByName(sorted_rows.select(along.columns)).join(starts, groups)
    place = F.when(turned, F.col("start") + F.col("__n") - 1 - F.col("rank")).otherwise(F.col("bucket_start") + F.col("rank"))
    return out.withColumn("out_pos", place.cast("long")).select(*df.columns, "route", "out_pos")


def reverse_positions(df: DataFrame, pos: str, n: int) -> DataFrame:
    """Positions of an input known to be descending, whose positions are 0 .. n - 1: no shuffle."""
    return df.withColumn("out_pos", F.lit(n - 1) - F.col(pos))


def bucket_reverse_positions(df: DataFrame, bucket: Column, pos: str) -> DataFrame:
    """Every bucket's rows in reverse: its start, plus its size less one, less the row's place."""
    rows = ranked(df.withColumn("bucket", bucket), ["bucket"], pos)
    return rows.withColumn("out_pos", (F.col("group_start") + F.col("group_n") - 1 - F.col("rank")).cast("long")).drop("rank", "group_start", "group_n")


def tuple_counting_sort(df: DataFrame, key: str, pos: str, mask: int) -> DataFrame:
    """Counting sort by the bits of mask, stable by position: tuple_index and out_pos."""
    rows = ranked(df.withColumn("tuple_index", u64.compress(F.col(key), mask)), ["tuple_index"], pos)
    return rows.withColumn("out_pos", (F.col("group_start") + F.col("rank")).cast("long")).drop("rank", "group_start", "group_n")


def order_shortcut(df: DataFrame, key: str, pos: str, unsigned: bool = True) -> str | None:
    """ASCENDING or DESCENDING (without ties) where the input's order makes a sort needless, else None.

    pos must be 0 .. n - 1, which is checked; keys must not be null.
    """
    found = order_scan(df, key, pos, unsigned).first()
    span = df.agg(F.min(pos), F.max(pos), F.count(F.lit(1)), F.count(key)).first()
    if span[2] and not (span[0] == 0 and span[1] == span[2] - 1 and span[3] == span[2]):
        return None
    return "ASCENDING" if found.ascending is not False else "DESCENDING" if found.falling else None


def adaptive_sort(df: DataFrame, key: str, pos: str, unsigned: bool = True) -> DataFrame:
    """Positions by the cheapest sufficient way: none for sorted, a projection for reversed input."""
    found = order_shortcut(df, key, pos, unsigned)
    if found == "ASCENDING":
        return df.withColumn("out_pos", F.col(pos).cast("long"))
    if found == "DESCENDING":
        return df.withColumn("out_pos", (F.lit(df.count() - 1) - F.col(pos)).cast("long"))
    return bucket_sort_positions(df, key, pos, unsigned)
