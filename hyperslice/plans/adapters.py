"""The given tables as the library's inputs, in DataFrame form and as SQL text for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GAP_NS = 900 * 10**9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long")
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance events: stream, t_ns, seq, s, o, etype, value."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return e.select(F.concat(F.lit("h"), F.col("user_id") % 7).alias("stream"), (micros(F.col("ts")) * 1000).alias("t_ns"), F.col("event_id").alias("seq"), F.concat(F.lit("n"), F.col("user_id") % 10).alias("s"), F.concat(F.lit("n"), k % 10).alias("o"), F.concat(F.lit("EVENT_"), F.upper("event_type")).alias("etype"), "value")


EVENTS = """ev AS (SELECT 'h' || (user_id % 7) AS stream, epoch_us(ts) * 1000 AS t_ns, event_id AS seq, 'n' || (user_id % 10) AS s,
    'n' || (CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 10) AS o, 'EVENT_' || upper(event_type) AS etype, value FROM events)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    port = F.get(F.array(*[F.lit(p) for p in (22, 53, 80, 443, 445, 3389)]), (k % 6).cast("int"))
    return e.select(
        F.col("event_id").alias("packet_id"), (micros(F.col("ts")) / 1e6 / 3000).alias("timestamp"), F.concat(F.lit("10.0.0."), F.col("user_id") % 3).alias("src_ip"),
        F.when(k % 4 == 0, F.concat(F.lit("8.8.4."), k % 2)).otherwise(F.concat(F.lit("10.0.0."), k % 3)).alias("dst_ip"), F.lit(40000).alias("src_port"), port.alias("dst_port"),
        F.when(F.col("event_type") == "error", "UDP").otherwise("TCP").alias("protocol"), F.floor(F.col("value") * 100).alias("packet_len"),
    )


PACKETS = """pk AS (SELECT event_id AS packet_id, epoch_us(ts) / 1e6 / 3000 AS timestamp, '10.0.0.' || (user_id % 3) AS src_ip,
    CASE WHEN k % 4 = 0 THEN '8.8.4.' || (k % 2) ELSE '10.0.0.' || (k % 3) END AS dst_ip, 40000 AS src_port, ([22, 53, 80, 443, 445, 3389])[k % 6 + 1] AS dst_port,
    CASE WHEN event_type = 'error' THEN 'UDP' ELSE 'TCP' END AS proto, CAST(floor(value * 100) AS BIGINT) AS bytes
    FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events))"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypergraph memberships (hid, token, type) of lineitem: parts and suppliers are entities, return flags events."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").repartition("l_orderkey")  # before rows become three
    token = F.explode(F.array(F.struct(F.concat(F.lit("P_"), "l_partkey").alias("token"), F.lit("entity").alias("type")), F.struct(F.concat(F.lit("S_"), "l_suppkey").alias("token"), F.lit("entity").alias("type")), F.struct(F.concat(F.lit("EVT:"), "l_returnflag").alias("token"), F.lit("event").alias("type"))))
    return li.select(F.col("l_orderkey").alias("hid"), token.alias("m")).select("hid", "m.token", "m.type").distinct()


MEMBERS = """mm AS (SELECT DISTINCT hid, token, type FROM (SELECT l_orderkey AS hid, 'P_' || l_partkey AS token, 'entity' AS type FROM lineitem
    UNION ALL SELECT l_orderkey, 'S_' || l_suppkey, 'entity' FROM lineitem UNION ALL SELECT l_orderkey, 'EVT:' || l_returnflag, 'event' FROM lineitem)),
    nf AS (SELECT token, min(hid * 2 + CASE WHEN type = 'entity' THEN 0 ELSE 1 END) AS f FROM mm GROUP BY token),
    nn AS (SELECT row_number() OVER (ORDER BY f, token) - 1 AS node_id, token, CASE WHEN f % 2 = 0 THEN 'entity' ELSE 'event' END AS type FROM nf),
    ic AS (SELECT nn.node_id, mm.hid FROM mm JOIN nn USING (token))"""


#: One hop around each hyperedge as hypergraph.subgraphs takes it with 48 hyperedges and 48 of each node: (target, hid, depth).
_PICK = lambda seed: f"(m{seed} * m{seed} + 12345) % 2147483647"
_MIX = lambda seed: f"((((({seed}::BIGINT * 7919 + target % 2147483647) % 2147483647) * 7919 + node_id % 2147483647) % 2147483647) * 7919 + j) % 2147483647 * 48271 % 2147483647 AS m{seed}"
HOP = f"""{MEMBERS}, lp AS (SELECT node_id, hid, row_number() OVER (PARTITION BY node_id ORDER BY hid) - 1 AS pos FROM ic), dg AS (SELECT node_id, count(*) AS degree FROM ic GROUP BY node_id),
    tn AS (SELECT hid AS target, node_id, row_number() OVER (PARTITION BY hid ORDER BY node_id) AS npos FROM ic),
    dj AS (SELECT target, node_id, npos, degree, unnest(range(least(degree, 48))) AS j FROM tn JOIN dg USING (node_id) WHERE npos <= 192),
    dm AS (SELECT *, {_MIX(42)}, {_MIX(43)}, j * degree // 48 AS lo, (j + 1) * degree // 48 AS hi FROM dj),
    dp AS (SELECT target, node_id, npos, j, CASE WHEN degree > 48 THEN lo + {_PICK(42)} % (hi - lo) ELSE j END AS pos, CASE WHEN degree > 48 THEN {_PICK(43)} ELSE j END AS turn FROM dm),
    fd AS (SELECT target, hid, min((npos, turn, j)) AS first FROM dp JOIN lp USING (node_id, pos) WHERE hid <> target GROUP BY ALL),
    sm AS (SELECT target, hid, 1 AS depth FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY first) AS r FROM fd) WHERE r < 48 UNION ALL SELECT DISTINCT hid, hid, 0 FROM ic)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


SCORES = """vx AS (SELECT vec_id AS id, label AS y, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    pm AS (SELECT y AS label, pos, avg(x) AS m FROM vx GROUP BY ALL),
    pp AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS val FROM pm),
    lg AS (SELECT id, y, label, sum(x * val) / sqrt(sum(x * x)) / 0.1 AS logit FROM vx JOIN pp USING (pos) GROUP BY ALL),
    sc AS (SELECT id, y, label, logit, exp(logit - max(logit) OVER w) / sum(exp(logit - mx)) OVER w AS p FROM (SELECT *, max(logit) OVER (PARTITION BY id) AS mx FROM lg) WINDOW w AS (PARTITION BY id)),
    pr AS (SELECT id, any_value(y) AS y, first(label ORDER BY logit DESC, label) AS pred, list(label ORDER BY logit DESC, label) AS all_labels,
           1 - sum(CASE WHEN label = 0 THEN p ELSE 0 END) AS anomaly, first(label ORDER BY logit DESC, label) FILTER (WHERE label <> 0) AS anomaly_type FROM sc GROUP BY id)"""
