"""Exact deduplication by content sort, with built-in functions only.

Sampled splitters range-partition the texts on their leading bytes and a 64-bit hash (so
the sample that reaches the driver is a few bytes a row); within a range the external sort
puts equal texts next to each other, and the window compares each full text with its
neighbour. A text with more rows or bytes than a quarter of a mean partition is dealt out
over salted ranges; the runs of such a text are merged by one pre-aggregated row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.storage import partitions

#: Least rows and bytes of a text that count as a hot group.
HOT_ROWS, HOT_BYTES = 256, 8 << 20


def content_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """All rows and columns of df, in a struct `row`, with the group of equal texts.

    Adds keep_id (largest or smallest id of the group), group_size, kept and text_sha256.
    A null text counts as empty. A null id is the smallest for keep="max" and the largest
    for keep="min", so it is kept only in a group without other ids. Of repeated rows with
    one id, one stays. An empty table gives an empty result. Columns of df may have any
    name, as they stay inside `row`.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is max or min")
    spark = df.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [c for c in df.columns if c != text_col]
    base = df.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("o"),
        F.col(id_col).alias("id"),
        F.col(text_col).isNull().alias("no_text"),
        text.alias("t"),
    ).withColumns({"p": F.substring("t", 1, 16), "h": F.xxhash64("t")})

    rows, size = base.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    hot_rows, hot_bytes = max(HOT_ROWS, rows // (4 * n)), max(HOT_BYTES, size // (4 * n))
    # At most 8 n groups pass this filter, whatever the input, so the driver may hold them.
    hot = (
        base.groupBy("h")
        .agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("t")).alias("b"))
        .filter((F.col("c") > hot_rows) | ((F.col("b") > hot_bytes) & (F.col("c") > 1)))
        .select("h", F.ceil(F.greatest(F.col("c") / hot_rows, F.col("b") / hot_bytes)).cast("int").alias("salts"))
        .collect()
    )
    if hot:
        salts = F.broadcast(spark.createDataFrame(hot, "h long, salts int"))
        base = base.join(salts, "h", "left").withColumn("s", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")))
    else:
        base = base.withColumn("salts", F.lit(None).cast("int"))
    # A constant salt would hide from the planner that the ranges hold whole groups.
    key = ["p", "h", *(["s"] if hot else [])]

    order = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    run = Window.partitionBy(*key, "t").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = base.repartitionByRange(n, *key).select(
        "o", "no_text", "id", "t", "salts",
        F.first("id").over(run).alias("run_keep"),
        F.row_number().over(run).alias("rn"),
        F.count(F.lit(1)).over(whole).alias("run_size"),
    ).withColumn("sha", F.sha2(F.col("t").cast("binary"), 256))
    keep_id, group = F.col("run_keep"), F.col("run_size")
    if hot:
        best = (F.max if keep == "max" else F.min)("id")
        merged = (
            base.filter(F.col("salts").isNotNull())
            .groupBy("h", "t")
            .agg(best.alias("hot_keep"), F.count(F.lit(1)).alias("hot_size"))
            .select(F.sha2(F.col("t").cast("binary"), 256).alias("sha"), "hot_keep", "hot_size")
        )
        # One row for each hot group: at most 8 n rows of 50 bytes.
        local = local.join(F.broadcast(merged), "sha", "left")
        keep_id = F.when(F.col("hot_size").isNotNull(), F.col("hot_keep")).otherwise(keep_id)
        group = F.coalesce("hot_size", group)
    row = F.struct(*[(F.when(F.col("no_text"), F.lit(None)).otherwise(F.col("t")) if c == text_col else F.col("o").getField(c)).alias(c) for c in df.columns])
    return local.select(
        row.alias("row"),
        keep_id.alias("keep_id"),
        group.cast("long").alias("group_size"),
        ((F.col("rn") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of df that stay, with the columns of df."""
    return content_groups(df, id_col, text_col, keep).filter("kept").select("row.*")
