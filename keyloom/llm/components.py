"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.storage import adopt, discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over undirected edges u > v: neighbours are linked to the least of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # A node of many edges makes a skewed join, which adaptive execution splits.
    linked = both.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v long), root being the component's least node.

    Loops and repeated edges don't matter; edges with a null end are left out. Each step is
    written to the shared folder; the loop ends when a step changes no edge.
    """
    edges = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    # The exclusive or of the edges' hashes and their number tell whether a step changed any.
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
    before = state(edges)
    while True:
        # Where every edge of a node leads to a root that has none above, all is done.
        step = materialize(_stars(_stars(edges, True), False), "edges")
        after = state(step)
        discard(edges)
        if after == before:
            return adopt(step.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(step.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), step)
        edges, before = step, after
