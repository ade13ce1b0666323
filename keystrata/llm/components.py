"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import saved


def _least(edges: DataFrame) -> DataFrame:
    """Each node with its least neighbour or itself, whichever is less."""
    return edges.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (a, b; 64-bit ids) with the least node it reaches: (node, component).

    Large stars hang every greater neighbour of a node onto the node's least neighbour; small
    stars do so with lesser neighbours.  The rounds, logarithmic in practice, end when the
    edges no longer change, and each is a table in the shared folder.  Degrees are combined
    map-side, and a node of great degree is split by adaptive skew joins.
    """
    now = saved(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = saved(large.where("a != b").distinct(), "large-stars")
        # a is the greater end: its lesser neighbours, and itself, go to the least of them
        low = _least(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = low.select("a", F.col("low").alias("b"))
        now = saved(small.unionByName(own).where("a != b").distinct(), "small-stars")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
