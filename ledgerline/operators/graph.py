"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is one or two shuffles of the edges and ends in a written table; no vertex, edge list or component passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.shared import Scratch


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """Point each vertex's larger (or smaller) neighbours at the least vertex that it touches."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = pairs.join(least, "a")
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the vertices of `edges` (a, b); loops and repeated edges do nothing.

    Vertices without edges do not appear; empty edges give an empty table.
    """
    scratch, step, before = Scratch(edges.sparkSession, "connected"), 0, None
    now = edges.select("a", "b").where("a <> b").distinct()
    while True:
        now = scratch.keep(_round(_round(now, True), False), f"{step}")
        if step:
            scratch.drop(f"{step - 1}")
        # A star forest is stable: the multiset of edges no longer changes.
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, step = mark, step + 1
