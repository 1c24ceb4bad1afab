"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long), undirected; loops, repeats and null ends are ignored.

    Returns (node, component): every node with a link to a smaller node, and the smallest node that it reaches.
    Nodes that are the smallest of their component, or have no links, have no row. An empty table gives an empty table.
    A hub's links are only ever reduced by min (partial aggregation) or joined with its one minimum, so that no task
    needs all of them.
    """
    links = edges.filter("a is not null and b is not null and a <> b")
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, links = links, materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(old)
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
