"""Resharding by minimum-cost flow.

The sizes of the old shards and the capacities of the new ones are the supplies and demands
of a flow that costs a byte for every byte that leaves its shard; it is solved on the driver,
for its graph has a node a shard. Rows of an old shard are ordered by a hash of their group
(equal texts), and each amount of the flow is a block, an interval of that order. The hash
values at the blocks' ends come from sums over cells of old shard and leading hash bits and
from a sort of the few cells that an end falls into. Documents next to an end may then go to
any of their old shard's blocks, whichever makes the shards' sizes more equal; these few are
listed one by one.
So which shard a row goes to is a lookup: no text is moved but into the new files, and only
shards that gain or lose rows are written.

Groups stay in one shard unless they are large (over a LARGEth part of a shard): rows of
those are ordered by text and id, and go where the room is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.flow import transfers
from keyloom.llm.storage import partitions

#: Bytes that a document counts besides its text.
OVERHEAD = 16
#: Cells over all old shards, rows that a cell has at least on average, units on either side of
#: an end that may change sides, and parts of a mean shard beyond which a group is large.
CELLS, ROWS, NEAR, LARGE = 1 << 16, 256, 64, 8
RANKS = 10


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def capacities(total: int, n: int) -> list[int]:
    return [total * (j + 1) // n - total * j // n for j in range(n)]


def evened(units: dict, over: np.ndarray, least: float = 0) -> dict:
    """{unit: shard}: changes that lower the sum of squares of `over`, bytes beyond each capacity.

    units: {unit: (size, shard, shards it may go to)}. The best move of a unit is made until
    none helps, then the best exchange of two units of an uneven shard and another, and so
    on, while a shard is off by more than `least`.
    """
    keys = list(units)
    rows = [(k, units[u][0], j) for k, u in enumerate(keys) for j in sorted(units[u][2])]
    if not rows:
        return {}
    who, size, to = (np.array(x) for x in zip(*rows, strict=True))
    now, over = np.array([units[u][1] for u in keys]), over.astype(float)

    def move(row: int) -> None:
        j = now[who[row]]
        over[j] -= size[row]
        over[to[row]] += size[row]
        now[who[row]] = to[row]

    def exchange() -> bool:
        for j in np.argsort(-np.abs(over), kind="stable"):
            gone, come, best = None, None, 0.0
            leave, enter = np.flatnonzero((now[who] == j) & (to != j)), np.flatnonzero((to == j) & (now[who] != j))
            for k in np.unique(to[leave]):
                a, b = leave[to[leave] == k], enter[now[who[enter]] == k]
                if len(a) and len(b):
                    d = size[a][:, None] - size[b][None, :]
                    gain = d * (d - (over[j] - over[k]))
                    if gain.min() < best:
                        best = gain.min()
                        gone, come = a[gain.argmin() // len(b)], b[gain.argmin() % len(b)]
            if gone is not None:
                move(gone)
                move(come)
                return True
        return False

    while np.abs(over).max() > least:
        gain = np.where(to == now[who], 0.0, size * (size - (over[now[who]] - over[to])))
        if gain.min() < 0:
            move(int(gain.argmin()))
        elif not exchange():
            break
    return {u: int(now[k]) for k, u in enumerate(keys) if now[k] != units[u][1]}


def plan_blocks(df: DataFrame, n_new: int, n_old: int, capacity: list[int] | None = None, rows: int = 0) -> tuple[list, dict]:
    """(old shard, first hash, last hash, new shard) of all blocks, in order, and exceptions.

    df has old, h and size, and about `rows` rows. Exceptions are {(old, h): new shard} of units
    (rows of one old and h) near the blocks' ends, at most 2 * NEAR for each end.
    """
    bits = max(0, min(CELLS // n_old, rows // (n_old * ROWS)).bit_length() - 1)
    cell = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long")
    cells = df.groupBy("old", cell.alias("cell")).agg(F.sum("size").alias("size")).collect()
    by: dict[int, list[tuple[int, int]]] = {}
    for old, c, size in sorted(cells):
        by.setdefault(old, []).append((c, size))
    supply = [sum(s for _, s in by.get(i, [])) for i in range(n_old)]
    demand = capacity or capacities(sum(supply), n_new)
    outgoing: dict[int, list[tuple[int, int]]] = {}
    for (i, j), x in transfers(supply, demand).items():
        outgoing.setdefault(i, []).append((j, x))
    # Ends of blocks, what stays first, with the cell they fall into and the bytes below it.
    ends, cuts = [], {}
    for i in range(n_old):
        at, k, below = 0, 0, 0
        for j, x in sorted(outgoing.get(i, []), key=lambda y: (y[0] != i, y[0])):
            at += x
            ends.append((i, at, j))
            while below + by[i][k][1] < at:
                below, k = below + by[i][k][1], k + 1
            if at < below + by[i][k][1]:
                cuts[i, at] = by[i][k][0], below
            else:
                cuts[i, at] = by[i][k][0], None
    near: dict[tuple[int, int], list] = {}
    inner = [(i, c, at, below) for (i, at), (c, below) in cuts.items() if below is not None]
    if inner:
        spark = df.sparkSession
        wanted = F.broadcast(spark.createDataFrame(inner, "old int, cell long, cut long, below long"))
        some = F.broadcast(spark.createDataFrame(sorted({(i, c) for i, c, _, _ in inner}), "old int, cell long"))
        equal = df.withColumn("cell", cell).join(some, ["old", "cell"], "left_semi").groupBy("old", "cell", "h").agg(F.sum("size").alias("size"))
        run = equal.withColumn("end", F.sum("size").over(Window.partitionBy("old", "cell").orderBy("h")))
        far = F.col("below") * 2 + F.col("end") * 2 - F.col("size") - F.col("cut") * 2
        close = run.join(wanted, ["old", "cell"]).withColumn("far", far)
        rank = F.row_number().over(Window.partitionBy("old", "cut", F.col("far") > 0).orderBy(F.abs("far"), "h"))
        # At most 2 * NEAR rows for each block.
        for r in close.withColumn("rank", rank).filter(F.col("rank") <= NEAR).select("old", "cut", "h", "size", "end", "far").collect():
            near.setdefault((r.old, r.cut), []).append((r.h, r.size, r.end, r.far))
    blocks, low, held, units = [], {}, [0] * n_new, {}
    for i, e, j in ends:
        c, below = cuts[i, e]
        start, before = low.get(i, (-(1 << 63), 0))
        if below is None:
            stop, at = ((c + 1) << (64 - bits)) - 1 if bits else (1 << 63) - 1, e
        else:
            left = [x for x in near[i, e] if x[3] <= 0]
            h, _, end, _ = max(left, default=((c << (64 - bits) if bits else -(1 << 63)) - 1, 0, 0, 0))
            stop, at = h, below + end
        if e == supply[i]:
            stop, at = (1 << 63) - 1, e
        if start <= stop:
            blocks.append((i, start, stop, j))
            held[j] += at - before
        low[i] = max(start, stop + 1), max(before, at)
    shards = {}
    for i, _, stop, j in blocks:
        shards.setdefault(i, []).append((stop, j))
    for (i, _), found in near.items():
        for h, size, _, _ in found:
            units[i, h] = size, next(j for stop, j in shards[i] if h <= stop), {j for _, j in shards[i]}
    return blocks, evened(units, np.array(held) - np.array(demand), sum(demand) / n_new / 1000)


def assign(df: DataFrame, n_new: int, n_old: int, capacity: list[int] | None = None, rows: int = 0) -> tuple[DataFrame, list, dict]:
    """df with its new shard in column shard, the blocks and the exceptions; df has old, h and size."""
    blocks, other = plan_blocks(df.select("old", "h", "size"), n_new, n_old, capacity, rows)
    spark = df.sparkSession
    by: dict[int, list] = {}
    for i, _, stop, j in blocks:
        by.setdefault(i, []).append((stop, j))
    ends = spark.createDataFrame(sorted(by.items()), "old int, ends array<struct<stop:long,shard:int>>")
    to = F.filter("ends", lambda e: F.col("h") <= e["stop"])[0]["shard"]
    out = df.join(F.broadcast(ends), "old", "left").withColumn("shard", to).drop("ends")
    if other:
        table = spark.createDataFrame([(i, h, j) for (i, h), j in sorted(other.items())], "old int, h long, other int")
        out = out.join(F.broadcast(table), ["old", "h"], "left").withColumn("shard", F.coalesce("other", "shard")).drop("other")
    return out, blocks, other


def reshard(df: DataFrame, path: str, n_new: int, old: Column, n_old: int, capacity: list[int] | None = None) -> DataFrame:
    """Write df (doc_id, text and other columns) into folders shard=<j> below path.

    old gives the row's present shard, from 0 to n_old - 1. Only shards that gain or lose rows
    are written; the rows of the others, which stay in their files, are returned, as (row,
    size, h, shard). Files have row, a struct of df's columns of whatever names, size and h.
    Equal texts of one old shard stay together unless they are large. A null text has no
    bytes and is equal to an empty one, a null id hashes like any other, repeated rows stay;
    an empty table writes no file.
    """
    spark = df.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), old.cast("int").alias("old"), text.alias("t"), F.col("doc_id").alias("id"))
    base = base.withColumns({"g": F.xxhash64("t"), "size": (F.octet_length("t") + OVERHEAD).cast("long")})
    count, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # At most LARGE * n_new groups.
    large = base.groupBy("g").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c")).filter((F.col("c") > 1) & (F.col("s") > total // (LARGE * n_new))).select("g").collect()
    h = F.when(F.col("g").isin([r.g for r in large]), F.xxhash64("g", "id")).otherwise(F.col("g")) if large else F.col("g")
    rows = base.withColumn("h", h).select("row", "old", "h", "size", "id")
    placed, blocks, other = assign(rows, n_new, n_old, capacity, count)
    changed = affected(blocks, other)
    kept = placed.filter(~F.col("shard").isin(sorted(changed))).select("row", "size", "h", "shard")
    moved = placed.filter(F.col("shard").isin(sorted(changed)))
    ordered = moved.repartitionByRange(partitions(spark), "shard", "h").sortWithinPartitions("shard", "h", "id")
    ordered.select("row", "size", "h", "shard").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return kept


def affected(blocks: list, other: dict) -> set[int]:
    """Shards that gain or lose rows."""
    moves = [(i, j) for i, _, _, j in blocks] + [(i, j) for (i, _), j in other.items()]
    out = {x for i, j in moves if i != j for x in (i, j)}
    # A unit that a block moves away and an exception returns still splits that block.
    return out | {j for (i, h), j in other.items() for a, lo, hi, to in blocks if a == i and lo <= h <= hi for j in (to, j)}


def slots(rows: DataFrame) -> DataFrame:
    """rows (doc_id, size, h, shard and others) with their gapless slot in the shard, by h and id."""
    rows = rows.withColumn("cell", F.shiftright("h", 64 - RANKS))
    cells = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    base = cells.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("h", "doc_id"))
    return rows.withColumn("rank", rank).join(base, ["shard", "cell"]).withColumn("slot", F.col("base") + F.col("rank") - 1).drop("base", "rank", "cell", "h")


def read_shards(spark: SparkSession, path: str, kept: DataFrame) -> DataFrame:
    """All rows after reshard(): (row, size, h, shard) of the written and of the kept shards."""
    return spark.read.schema(kept.schema).parquet(path).unionByName(kept)
