"""Links within groups of nodes that meet at a key, without pairing a group's nodes with one another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .common import materialize
from .components import connected_components


def connect(crowd: DataFrame, found: DataFrame, exact: Callable[[DataFrame, str], DataFrame], rest: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """found(a, b), with links that make all nodes at a key of crowd(key, node, n) one component that links there would.

    Each group's nodes are compared with one of them, the hub (the one in most crowded keys: the original of many
    copies), then those that aren't linked to it with a next hub, for `rounds` rounds. exact(pairs, name) gives the pairs
    (a, b) that are links. Groups that several components are left of go to rest(groups), groups(hub, node, c) with the
    first hub and the component: links that, with those found, connect what links within a group do. So no link is lost;
    `rounds` only saves work.
    """
    rank = crowd.groupBy("node").agg(F.struct((-F.sum("n")).alias("n"), "node").alias("rank"))
    met = materialize(crowd.select("key", "node").distinct().join(rank, "node"), "crowds")
    # From here on a group is all nodes at keys of one first hub, and of hubs that first stand in one of its keys.
    heads = met.groupBy("key").agg(F.min("rank").alias("hub"))
    parts = materialize(met.join(heads, "key").select("hub", "node", "rank").distinct(), "parts")
    into = parts.groupBy("node").agg(F.min("hub").alias("to")).select(F.col("node").alias("of"), F.col("to.node").alias("group"))
    left = groups = materialize(parts.join(into, F.col("hub.node") == F.col("of")).select("group", "node", "rank").distinct(), "groups")
    hubs = groups.select("group", F.col("group").alias("hub")).distinct()
    for number in range(rounds):
        if number:
            hubs = materialize(left.groupBy("group").agg(F.min("rank").alias("hub")).select("group", F.col("hub.node").alias("hub")), "hubs")
        stars = left.join(hubs, "group").filter("node <> hub")
        new = exact(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
        found = found.union(new)
        left = materialize(stars.join(new.select(F.col("a").alias("hub"), F.col("b").alias("node")), ["hub", "node"], "left_anti").select("group", "node", "rank"), "left")
        if left.isEmpty():
            return found
    rows = groups.select("group", "node").join(connected_components(found), "node", "left").withColumn("c", F.coalesce("component", "node"))
    several = rows.groupBy("group").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("group")
    rows = materialize(rows.join(several, "group", "left_semi").select(F.col("group").alias("hub"), "node", "c"), "several")
    return found if rows.isEmpty() else found.union(rest(rows))
