"""Connected components of a table of links, by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch

MOST_STEPS = 50


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its least node) of every node that has a link to another.

    A step hangs every neighbour of a node under the node's least neighbour. Aggregations combine before they shuffle;
    what they give is written, so that the joins with it are plain ones, which Spark splits where a node has very many
    links. Each step's links are written to the shared folder; there are about as many steps as the logarithm of the
    longest path, and more than MOST_STEPS is an error. Links with a null end, and of a node with itself, are ignored;
    repeated ones count once. No links give an empty result.
    """
    links = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    links, mark = scratch.write(links, "links"), None
    for _ in range(MOST_STEPS):
        # large star: neighbours above a node go under the least of the node and its neighbours
        both = links.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(links.select(F.col("low").alias("node"), F.col("high").alias("other")))
        least = scratch.write(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least")), "least")
        large = scratch.write(both.join(least, "node").filter("other > node").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct(), "large")
        # small star: neighbours below a node, and the node, go under the least of them
        lower = scratch.write(large.groupBy("high").agg(F.min("low").alias("least")), "lower")
        near = large.join(lower, "high")
        small = near.filter("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low")).unionByName(lower.select("high", F.col("least").alias("low"))).distinct()
        before, links = links, scratch.write(small, "links")
        scratch.drop(before, least, large, lower)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first()
        if now == mark:
            roots = links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            return links.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots)
        mark = now
    raise RuntimeError(f"components are not complete after {MOST_STEPS} steps")
