"""Connected components by alternating large-star and small-star steps, as DataFrame joins.

Hubs are safe: each step takes a minimum per node (combined on the map side) and joins it back to
the edges of the node, a join that Spark splits where a hub holds most of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node near it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node (a > b) and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    ``edges`` has columns a and b (long); loops, nulls, repeats and either direction are fine. Nodes
    without a link to another node aren't returned. Each step is written to the shared folder.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = staged(links, name)
    state = _state(links)
    while True:
        links = staged(_small_star(_large_star(links)), name)
        before, state = state, _state(links)
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
