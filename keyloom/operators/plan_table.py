"""The plan as a table: descriptors, states, routes, passes and statistics of all buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import u64
from keyloom.operators.descriptors import bucket_descriptors, bucket_of
from keyloom.operators.order import order_scan
from keyloom.plans import planner
from keyloom.plans.planner import Config

PLAN = "bucket long, start long, n long, or_mask long, and_mask long, vbm long, rvb long, state string, falling boolean, route string, tiny_tier string, n_cycles int, cycles array<struct<shift:int,mask:long>>, tail_mask long, tuple_bits int, tuple_in_place boolean, local_shift int, local_bits int, off_heap boolean, score long, needs_work boolean"


def bucket_states(df: DataFrame, key: str, pos: str, shift: int, bits: int = 13, unsigned: bool = True) -> DataFrame:
    """Plan rows with each bucket's order in the input and its state."""
    plan = bucket_descriptors(df, key, shift, bits, unsigned)
    rows = df.filter(F.col(key).isNotNull()).withColumn("bucket", bucket_of(F.col(key).cast("long"), shift, bits, unsigned))
    order = order_scan(rows, key, pos, unsigned, ("bucket",)).select("bucket", "ascending", "descending", "falling")
    kind = F.when((F.col("n") <= 1) | (F.col("vbm") == 0), "ALL_EQUAL").when(F.col("ascending"), "ASCENDING").when(F.col("descending"), "DESCENDING").otherwise("MIXED")
    return plan.join(order, "bucket").withColumn("state", kind)


def plan_table(df: DataFrame, key: str, pos: str, shift: int, unsigned: bool = True, cfg: Config = Config()) -> DataFrame:
    """One row a bucket, at most 2^msd_bits of them, planned on the driver."""
    rows = bucket_states(df, key, pos, shift, cfg.msd_bits, unsigned).orderBy("bucket").collect()
    total = sum(r.n for r in rows)
    known = df.filter(F.col(key).isNotNull()).count()
    if total != known:
        raise ValueError(f"the plan has {total} rows of {known}")
    sparse = planner.sparse_parent(len(rows), 1 << cfg.msd_bits)
    tuples = sum(r.state == "MIXED" and r.n >= cfg.tiny and planner.tuple_fits(r.vbm & u64.MASK64, r.n, cfg) for r in rows)
    shifts, width = planner.local_shifts([(r.vbm & u64.MASK64, r.n, r.state) for r in rows], total, sparse, cfg)
    out = []
    for r, local in zip(rows, shifts, strict=True):
        vbm = r.vbm & u64.MASK64
        route = planner.route(r.n, vbm, r.state, cfg)
        c = planner.choose_cycles(vbm, r.n, cfg) if r.state == "MIXED" else planner.Cycles()
        direct = route == "tuple-direct"
        out.append((r.bucket, r.start, r.n, r.or_mask, r.and_mask, r.vbm, r.rvb, r.state, r.falling, route, planner.tiny_tier(r.n) if route == "tiny" else None, len(c.passes), [(s, u64.signed(m)) for s, m in c.passes], u64.signed(c.tail), planner.popcount(c.tail), planner.tuple_in_place(r.n, tuples, cfg) if direct else None, local, width if local >= 0 else 0, r.n > cfg.heap_rows, c.score, route != "done"))
    return df.sparkSession.createDataFrame(out, PLAN)


def step_trace(plan: DataFrame, workers: int = 8, stealing: bool = True, batch: int = 1) -> DataFrame:
    """The steps in which `workers` would take the plan's work, costs being rows times passes.

    step, worker, bucket, route, n, cost and clock (the worker's cost so far) of each bucket
    with work; at most 2^msd_bits rows, scheduled on the driver.
    """
    rows = {r.bucket: r for r in plan.filter("needs_work").select("bucket", "route", "n", "n_cycles", "tail_mask").collect()}
    work = [(b, r.n * max(1, r.n_cycles + (r.tail_mask != 0))) for b, r in rows.items()]
    steps = [(step, w, b, rows[b].route, rows[b].n, price, clock) for step, w, b, price, clock in planner.schedule(work, workers, stealing, batch)]
    return plan.sparkSession.createDataFrame(steps, "step int, worker int, bucket long, route string, n long, cost long, clock long")


def bucket_report(plan: DataFrame) -> DataFrame:
    """name and value of the figures of a plan: its statistics, mean bucket, and the sizes at quantiles."""
    q = [0.5, 0.9, 0.99]
    sizes = plan.agg(F.coalesce(F.min("n"), F.lit(0)).alias("smallest"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), *[F.percentile("n", F.lit(x)).alias(f"p{int(100 * x)}") for x in q], F.coalesce(F.bit_count(F.bit_or("vbm")), F.lit(0)).alias("variable_bits"))
    wide = plan_statistics(plan).join(sizes, how="cross")  # one row each
    names = wide.columns
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in names])).alias("r")).select("r.*")


def plan_flags(plan: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row: whether the source is final as it is, one bucket can be refined where it lies, any refining is left, and scratch memory is needed."""
    t = plan.agg(F.count(F.lit(1)).alias("buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.bool_or("needs_work"), F.lit(False)).alias("work"), F.coalesce(F.bool_or(F.col("local_shift") >= 0), F.lit(False)).alias("split"))
    one = F.col("buckets") <= 1
    return t.select((one & ~F.col("work")).alias("source_final"), ((F.col("buckets") == 1) & (F.col("largest") == F.col("rows")) & ~F.col("split")).alias("refine_in_source"), F.col("work").alias("needs_refinement"), (F.col("work") & (F.col("largest") > cfg.heap_rows)).alias("needs_scratch"))


def plan_statistics(plan: DataFrame) -> DataFrame:
    """Counts over the plan's buckets, in one row."""
    some = lambda c: F.count(F.when(c, 1))
    return plan.agg(
        F.count(F.lit(1)).alias("non_empty"),
        some(F.col("state") == "MIXED").alias("mixed"),
        some(F.col("state") == "ALL_EQUAL").alias("all_equal"),
        some(F.col("state") == "ASCENDING").alias("ascending"),
        some(F.col("state") == "DESCENDING").alias("descending"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        some(F.col("needs_work")).alias("needs_work"),
        some(F.col("route") == "tiny").alias("tiny"),
        some(F.col("route") == "tuple-direct").alias("tuple_direct"),
        some(F.col("route") == "lsd").alias("lsd"),
        some(F.col("route") == "lsd-tuple-tail").alias("lsd_tail"),
        some(F.col("local_shift") >= 0).alias("local_split"),
        some(F.col("off_heap")).alias("off_heap"),
        F.coalesce(F.sum("n_cycles"), F.lit(0)).alias("passes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def work_list(plan: DataFrame) -> DataFrame:
    """Buckets with work, largest first."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "bucket"))
    return plan.filter("needs_work").select(rank.cast("long").alias("rank"), "bucket", "n", "route")


def local_children(df: DataFrame, key: str, bucket: int, shift: int, bits: int, child_shift: int, child_bits: int, unsigned: bool = True) -> DataFrame:
    """Descriptors of a large bucket's second-level split."""
    rows = df.filter(bucket_of(F.col(key).cast("long"), shift, bits, unsigned) == bucket)
    return bucket_descriptors(rows, key, child_shift, child_bits, unsigned).withColumnRenamed("bucket", "child")
