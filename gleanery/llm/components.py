"""Connected components of links, by alternating stars over DataFrames. No link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import checkpointed


def linked_to_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's neighbours (with ``both_ways`` all, keeping the larger ones; else the smaller ones and itself), linked to the least of them."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    if both_ways:
        out = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = around.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows of (node, least) for every node of ``links`` (a, b) but the least of its component. Self links and repeats are fine."""
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] == 0 or now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("least"))
        state = now
        larger = linked_to_least(edges, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = checkpointed(linked_to_least(larger, False))
