"""Bidirectional flows of packets and their slice-level tactics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import rules


def normal_packets(packets: DataFrame) -> DataFrame:
    """Complete packets with ordered endpoints and the anchor host."""
    rows = packets.na.drop(subset=["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"])
    a, b = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    rows = rows.withColumns({"ep_a": F.least(a, b), "ep_b": F.greatest(a, b), "proto": F.upper("protocol"), "bytes": F.coalesce("packet_len", F.lit(0))})
    ia, ib = rules.is_internal(F.col("ep_a.ip")), rules.is_internal(F.col("ep_b.ip"))
    return rows.withColumn("anchor", F.when(ia, F.col("ep_a.ip")).when(ib, F.col("ep_b.ip")))


FLOW = ["ep_a", "ep_b", "proto", "bucket", "session"]


def sessions(packets: DataFrame, bucket_s: float = 1.0, idle_s: float = 1.0) -> DataFrame:
    """Normal packets with `bucket` and `session`: within an endpoint pair, protocol and time bucket a silence over idle_s starts
    a new flow."""
    rows = normal_packets(packets).withColumn("bucket", F.floor(F.col("timestamp") / bucket_s))
    order = Window.partitionBy(*FLOW[:-1]).orderBy("timestamp", "packet_id")
    gap = F.coalesce((F.col("timestamp") - F.lag("timestamp").over(order) > idle_s).cast("int"), F.lit(0))
    return rows.withColumn("_gap", gap).withColumn("session", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def biflows(packets: DataFrame, bucket_s: float = 1.0, idle_s: float = 1.0) -> DataFrame:
    """A1: packets of one endpoint pair, protocol and time bucket; a silence over idle_s starts a new flow."""
    rows = sessions(packets, bucket_s, idle_s)
    return rows.groupBy(*FLOW).agg(F.min("timestamp").alias("t_start"), F.max("timestamp").alias("t_end"), F.count("*").alias("packets"), F.sum("bytes").alias("bytes"), F.first("anchor").alias("anchor"))


#: Ports of lateral movement, of discovery, and of command and control; and the bounds of the tactic rules.
LATERAL = (22, 23, 135, 139, 445, 3389, 5985, 5986, 1433, 3306, 5432, 6379, 9200)
DISCOVERY = (137, 138, 139, 161, 445)
CONTROL = (53, 80, 443, 8080, 8443)
BOUNDS = {"peers": 20, "ports": 30, "quick_s": 10, "probed_peers": 5, "lateral_hits": 2, "inside": 3, "bytes": 2_000_000, "few_peers": 2, "lasting_s": 10, "packets": 10}


def tactics(flows: DataFrame, bounds: dict[str, float] | None = None) -> DataFrame:
    """A2 over flows(slice, anchor, peer, port, packets, bytes, t_start, t_end): tactic names joined by |, and what they
    follow from. peer and port are null for flows that don't touch the anchor; those count for the duration only."""
    at = BOUNDS | (bounds or {})
    touches, inside = F.col("peer").isNotNull(), rules.is_internal(F.col("peer"))
    hits = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    own = lambda c: F.coalesce(F.sum(F.when(touches, F.col(c))), F.lit(0))
    any_ = lambda ports: F.coalesce(F.max(F.col("port").isin(*ports)), F.lit(False))
    by = flows.groupBy("slice").agg(
        F.count_distinct("peer").alias("peers"), F.count_distinct("port").alias("ports"), own("bytes").alias("bytes"), own("packets").alias("packets"),
        hits(touches & inside).alias("inside"), hits(touches & ~inside).alias("outside"), hits(touches & inside & rules.is_internal(F.col("anchor")) & F.col("port").isin(*LATERAL)).alias("lateral_hits"),
        any_(LATERAL).alias("lateral"), any_(DISCOVERY).alias("discovery"), any_(CONTROL).alias("control"), F.greatest(F.lit(1e-6), F.max("t_end") - F.min("t_start")).alias("lasts"),
    )
    c = F.col
    many = (c("peers") >= at["peers"]) | (c("ports") >= at["ports"])
    tags = F.array_compact(F.array(
        F.when((many & (c("lasts") <= at["quick_s"])) | (c("discovery") & (c("peers") >= at["probed_peers"])), F.lit("TA0007:Discovery")),
        F.when((c("lateral_hits") >= at["lateral_hits"]) | ((c("inside") >= at["inside"]) & c("lateral")), F.lit("TA0008:LateralMovement")),
        F.when((c("outside") >= 1) & (c("bytes") >= at["bytes"]), F.lit("TA0010:Exfiltration")),
        F.when((c("outside") >= 1) & (c("peers") <= at["few_peers"]) & (c("lasts") >= at["lasting_s"]) & (c("packets") >= at["packets"]) & c("control"), F.lit("TA0011:CommandAndControl")),
    ))
    return by.withColumn("tactic", F.when(F.size(tags) > 0, F.array_join(tags, "|")).otherwise("TA0000:Benign"))


def histogram(packets: DataFrame, column: str, bucket_s: float = 1.0, idle_s: float = 1.0, missing: str | None = None) -> DataFrame:
    """(FLOW, counts, top): how often each value of a column occurs among a flow's packets, and the most frequent
    one, the first seen on ties. Null and empty values count as `missing`, without it they don't count."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(missing))
    rows = sessions(packets, bucket_s, idle_s).withColumn("value", value).filter("value is not null")
    by = rows.groupBy(*FLOW, "value").agg(F.count("*").alias("n"), F.min(F.struct("timestamp", "packet_id")).alias("first"))
    top = F.min_by("value", F.struct((-F.col("n")).alias("n"), "first"))
    return by.groupBy(*FLOW).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"), top.alias("top"))
