"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (a, b) that isn't the smallest of its component.

    Alternates the two steps of the star algorithm: every node hands its larger
    neighbours to its smallest neighbour, then its smaller ones.  Each step
    keeps the components, and the edges end as stars around the smallest node.
    Only grouped minima and joins on nodes are used; a round's edges are
    written, so that the plan does not grow.  An error tells of more than
    ``rounds`` rounds; they grow with the logarithm of the longest path.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lower.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = scratch.keep(small, "stars")
        mark = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
    raise RuntimeError(f"components are not found after {rounds} rounds")
