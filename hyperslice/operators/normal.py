"""Raw records as the library's events and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules


def packet_records(headers: DataFrame) -> DataFrame:
    """Decoded headers(ip_proto, src_port, dst_port, flags, ...) with `protocol`; ports only of TCP and UDP, flags only of TCP."""
    name = rules.transport(F.col("ip_proto"))
    ports = F.col("protocol").isin("TCP", "UDP")
    rows = headers.withColumn("protocol", name)
    return rows.withColumns({"src_port": F.when(ports, F.col("src_port")), "dst_port": F.when(ports, F.col("dst_port")), "flags": F.when(F.col("protocol") == "TCP", F.col("flags"))}).drop("ip_proto")


def host_events(raw: DataFrame) -> DataFrame:
    """Raw host events with t_ns, s, o, etype, host and ttp. Rows without a time, actor, object, action or object
    type, or whose ISO time can't be read, are left out; the time counts exact microseconds."""
    need = ["timestamp", "actorID", "objectID", "action", "object"]
    rows = raw.filter(" and ".join(f"coalesce({c}, '') <> ''" for c in need))
    rows = rows.withColumn("t_ns", F.unix_micros(F.try_to_timestamp("timestamp")) * 1000).filter("t_ns is not null")
    rows = rows.withColumns({"s": F.col("actorID").cast("string"), "o": F.col("objectID").cast("string"), "etype": F.concat(F.lit("EVENT_"), F.upper("action"), F.lit("_"), F.upper("object"))})
    return rows.withColumns({"host": F.coalesce("hostname", F.lit("")), "ttp": rules.event_technique(F.col("properties"))}).drop("properties")


def provenance_events(raw: DataFrame) -> DataFrame:
    """Provenance events(timestampNanos, subject, predicateObject, predicateObjectPath, names) as t_ns, s, o, etype
    (the first name) and ttp; rows without a time, subject, object or name are left out."""
    rows = raw.filter("timestampNanos is not null and subject is not null and predicateObject is not null and size(names) > 0")
    return rows.select(
        F.col("timestampNanos").cast("long").alias("t_ns"), F.col("subject").cast("string").alias("s"), F.col("predicateObject").cast("string").alias("o"),
        F.get("names", F.lit(0)).alias("etype"), rules.technique(F.col("predicateObjectPath")).alias("ttp"),
    )
