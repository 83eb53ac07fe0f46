"""Heavy keys and the sort that emits a dominant core first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import u64
from keyloom.operators.order import ranked
from keyloom.operators.sorting import bucket_sort_positions
from keyloom.plans.planner import Config


def heavy_keys(df: DataFrame, key: str, divisor: int = 1024) -> DataFrame:
    """Keys with at least max(2, rows / divisor) rows: at most `divisor` of them."""
    n = df.count()
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2, n // divisor))


def heavy_keys_approx(df: DataFrame, key: str, candidates: int = 64) -> DataFrame:
    """Candidates from the built-in top-k sketch over all rows, with exact counts."""
    found = df.agg(F.expr(f"approx_top_k({key}, {candidates})").alias("top")).select(F.explode("top").alias("t")).select(F.col("t.item").alias(key))
    return df.join(F.broadcast(found), key).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def dominant_core(df: DataFrame, key: str, unsigned: bool = True, cfg: Config = Config()) -> dict | None:
    """The heavy keys, if they have the share of rows asked for and all lie below the rest.

    Candidates come from a sketch over all rows, and only they are counted; with cfg.core off
    there is no core.
    """
    if not cfg.core:
        return None
    total = df.count()
    core = [(r[key], r.n) for r in heavy_keys_approx(df, key, max(cfg.core_candidates, 1)).filter(F.col("n") >= max(2, total // cfg.core_divisor)).collect()]
    n = sum(c for _, c in core)
    if not core or n * 100 < cfg.core_share * total or n >= total:
        return None
    k = u64.ordered(F.col(key), unsigned)
    least = df.filter(~F.col(key).isin([c for c, _ in core])).agg(F.min(k)).first()[0]
    view = (lambda x: u64.signed(x ^ (1 << 63))) if unsigned else (lambda x: x)
    return {"keys": sorted((view(c), c, m) for c, m in core), "n": n} if max(view(c) for c, _ in core) < least else None


def dominant_core_sort(df: DataFrame, key: str, pos: str, unsigned: bool = True, cfg: Config = Config()) -> DataFrame:
    """df with out_pos: core keys by their counts, the tail sorted behind them."""
    core = dominant_core(df, key, unsigned, cfg)
    if core is None:
        return bucket_sort_positions(df, key, pos, unsigned)
    spark = df.sparkSession
    starts, at = [], 0
    for _, k, n in core["keys"]:
        starts.append((k, at))
        at += n
    table = F.broadcast(spark.createDataFrame(starts, "core_key long, core_start long"))
    head = df.join(table, F.col(key) == F.col("core_key"))
    # A core key is hot, so ranks come from slices of positions.
    head = ranked(head, ["core_key"], pos).withColumn("out_pos", (F.col("core_start") + F.col("rank")).cast("long"))
    tail = bucket_sort_positions(df.filter(~F.col(key).isin([k for k, _ in starts])), key, pos, unsigned)
    return head.select(*df.columns, "out_pos").unionByName(tail.select(*df.columns, (F.col("out_pos") + core["n"]).alias("out_pos")))
