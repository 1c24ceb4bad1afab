"""Registered queries of the slice, graph, split, score and metric operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rules
from ..operators import flows, hypergraph, metrics, normal, ordered, packs, scoring, slicing, splits
from ..sources import files
from . import adapters as ad

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SLICED = f"""{ad.EVENTS}, e1 AS (SELECT *, lag(t_ns) OVER w AS pt, lag(o) OVER w AS po FROM ev WINDOW w AS (PARTITION BY stream ORDER BY t_ns, seq)),
    e2 AS (SELECT *, pt IS NULL OR t_ns - pt > {ad.GAP_NS} AS hard FROM e1), e3 AS (SELECT *, NOT hard AND (s = po OR o = po) AS link FROM e2),
    e4 AS (SELECT *, last_value(CASE WHEN NOT link THEN s END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY t_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM e3),
    sl AS (SELECT stream, t_ns, seq, s, o, etype, value, CAST(sum(CASE WHEN hard OR (NOT link AND s <> ps) THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t_ns, seq) AS BIGINT) - 1 AS slice_id FROM e4)"""


@query(f"WITH {SLICED} SELECT stream, slice_id, min(t_ns) AS t_start, max(t_ns) AS t_end, count(*) AS events_count FROM sl GROUP BY ALL")
def slice_events(spark: SparkSession, d: str) -> DataFrame:
    return slicing.slice_summary(slicing.slice_events(ad.events(spark, d), ad.GAP_NS))


@query(f"WITH {ad.EVENTS} SELECT s AS id FROM ev GROUP BY s HAVING count(*) >= 2 INTERSECT SELECT o FROM ev")
def process_set(spark: SparkSession, d: str) -> DataFrame:
    return slicing.process_set(ad.events(spark, d), 2)


@query(f"""WITH RECURSIVE {SLICED}, ps AS (SELECT s AS id FROM ev GROUP BY s INTERSECT SELECT o FROM ev),
    st AS (SELECT sl.*, ps.id IS NOT NULL AS is_p FROM sl LEFT JOIN ps ON ps.id = sl.o),
    walk AS (SELECT stream, slice_id, 1 AS n, arg_min(s, (t_ns, seq)) AS cur, [arg_min(s, (t_ns, seq))] AS path, false AS done FROM st GROUP BY stream, slice_id
        UNION ALL SELECT stream, slice_id, n + 1, x.o, list_append(path, x.o), NOT x.is_p OR list_contains(path, x.o)
        FROM (SELECT w.stream, w.slice_id, n, path, arg_min({{'o': o, 'is_p': is_p}}, (CASE WHEN is_p AND NOT list_contains(path, o) THEN 0 ELSE 1 END, t_ns, seq)) AS x
              FROM walk w JOIN st ON st.stream = w.stream AND st.slice_id = w.slice_id AND st.s = w.cur WHERE NOT done GROUP BY ALL))
    SELECT stream, slice_id, CAST(n AS INTEGER) AS chain_len, array_to_string(path, '>') AS path FROM walk
    WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY stream, slice_id ORDER BY n DESC) = 1""")
def slice_chains(spark: SparkSession, d: str) -> DataFrame:
    events = ad.events(spark, d)
    found = slicing.chains(slicing.slice_events(events, ad.GAP_NS), slicing.process_set(events))
    return found.select("stream", "slice_id", "chain_len", F.array_join(F.transform("chain", lambda x: x["entity"]), ">").alias("path"))


@query("""WITH r AS (SELECT user_id AS key, event_type AS name, ts, event_id, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS n
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    q AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY ts, event_id) AS run FROM r)
    SELECT key, CAST(run AS BIGINT) AS run, name, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS entities FROM q GROUP BY key, run, name""")
def rle_motifs(spark: SparkSession, d: str) -> DataFrame:
    e = ad.table(spark, d, "events")
    steps = e.select(F.col("user_id").alias("key"), F.struct(ad.micros(F.col("ts")).alias("t"), "event_id").alias("pos"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("entity"))
    return slicing.run_motifs(steps).withColumn("entities", F.array_join("entities", ","))


@query("""SELECT page_id, f AS file_name, CASE WHEN f LIKE '%firefox%' THEN 'T1189' WHEN f LIKE '%drakon%' THEN 'T1055' WHEN f LIKE '%verifier%' THEN 'T1546.012' WHEN f LIKE '%sysinfo%' THEN 'T1082'
    WHEN f LIKE '%copykatz%' OR f LIKE '%mimikatz%' THEN 'T1003' WHEN f LIKE '%filefilter-elevate%' THEN 'T1068' WHEN f LIKE '%ping%' THEN 'T1016' WHEN f LIKE '%cmd%' THEN 'T1059.003'
    WHEN f LIKE '%powershell%' THEN 'T1059.001' ELSE '' END AS ttp FROM (SELECT page_id, regexp_extract(lower(url), '[^/\\\\]*$') AS f FROM pages)""")
def ttp_rules(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "pages").select("page_id", rules.file_name(F.col("url")).alias("file_name"), rules.technique(F.col("url")).alias("ttp"))


@query("""SELECT doc_id, CASE WHEN t LIKE '%mimikatz%' OR t LIKE '%lsadump%' THEN 'T1003' WHEN t LIKE '%wmic%' OR t LIKE '%invoke-wmi%' OR t LIKE '%winmgmt%' THEN 'T1047' WHEN t LIKE '%powershell%' OR t LIKE '%empire%' THEN 'T1059.001'
    WHEN t LIKE '%reg add%' OR t LIKE '%reg.exe%' OR t LIKE '%registry%' THEN 'T1112' WHEN t LIKE '%ping%' OR t LIKE '%scan%' OR t LIKE '%nmap%' THEN 'T1046'
    WHEN t LIKE '%screenshot%' OR t LIKE '%screen%' OR t LIKE '%snipping%' THEN 'T1113' WHEN t LIKE '%psinject%' OR t LIKE '%lsass%' THEN 'T1055' ELSE '' END AS ttp
    FROM (SELECT doc_id, lower(coalesce(source, '') || ' | ' || coalesce(lang, '') || ' | ' || coalesce(text, '')) AS t FROM documents)""")
def host_event_rules(spark: SparkSession, d: str) -> DataFrame:
    """P8 with the documents' columns in the place of a host event's paths and command line."""
    docs = ad.table(spark, d, "documents").select("doc_id", F.struct(F.col("source").alias("image_path"), F.col("lang").alias("module_path"), F.col("text").alias("command_line")).alias("p"))
    return docs.select("doc_id", rules.event_technique(F.col("p")).alias("ttp"))


@query("""SELECT event_id, epoch_us(ts) * 1000 AS t_ns, 'u' || user_id AS s, 'o' || regexp_extract(props, '(\\d+)', 1) AS o, 'EVENT_' || upper(event_type) || '_FILE' AS etype, '' AS ttp
    FROM events WHERE event_type <> ''""")
def host_events(spark: SparkSession, d: str) -> DataFrame:
    """Events written as a host event's fields, with ISO times, and normalised."""
    e = ad.table(spark, d, "events")
    raw = e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"), F.concat(F.lit("u"), "user_id").alias("actorID"), F.concat(F.lit("o"), F.regexp_extract("props", r"(\d+)", 1)).alias("objectID"),
        F.col("event_type").alias("action"), F.lit("file").alias("object"), F.lit("h").alias("hostname"), F.struct(F.lit("").alias("image_path"), F.lit(None).cast("string").alias("module_path"), F.lit("").alias("command_line")).alias("properties"),
    )
    found = normal.host_events(raw.withColumn("timestamp", F.concat("iso", F.lit("Z"))))
    return found.select("event_id", "t_ns", "s", "o", "etype", "ttp")


@query("SELECT c_custkey, 'H_' || sha1('salt|' || c_name)[1:8] AS salted, c_name[1:8] AS raw FROM customer")
def entity_tokens(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "customer").select("c_custkey", rules.salted_token(F.col("c_name"), "salt", "H_").alias("salted"), F.substring("c_name", 1, 8).alias("raw"))


#: The key and its two pads, as hexadecimal digits.
_KEY = b"key"
_PADS = [bytes(b ^ pad for b in _KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(f"SELECT c_custkey, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(c_name))))[1:8] AS token FROM customer")
def keyed_tokens(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "customer").select("c_custkey", rules.keyed_token(F.col("c_name"), _KEY).alias("token"))


FLOWS = f"""{ad.PACKETS}, pa AS (SELECT *, floor(timestamp) AS bucket,
    CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_ip ELSE dst_ip END AS a_ip, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_port ELSE dst_port END AS a_port,
    CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_ip ELSE src_ip END AS b_ip, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_port ELSE src_port END AS b_port FROM pk),
    pb AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w > 1 THEN 1 ELSE 0 END AS gap FROM pa WINDOW w AS (PARTITION BY a_ip, a_port, b_ip, b_port, proto, bucket ORDER BY timestamp, packet_id)),
    pc AS (SELECT *, sum(gap) OVER (PARTITION BY a_ip, a_port, b_ip, b_port, proto, bucket ORDER BY timestamp, packet_id) AS session FROM pb),
    fl AS (SELECT a_ip, a_port, b_ip, b_port, proto, CAST(bucket AS BIGINT) AS bucket, CAST(session AS BIGINT) AS session, min(timestamp) AS t_start, max(timestamp) AS t_end, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes,
    CASE WHEN a_ip LIKE '10.%' THEN a_ip WHEN b_ip LIKE '10.%' THEN b_ip END AS anchor FROM pc GROUP BY ALL)"""


def _flows(spark: SparkSession, d: str) -> DataFrame:
    f = flows.biflows(ad.packets(spark, d))
    return f.select(F.col("ep_a.ip").alias("a_ip"), F.col("ep_a.port").alias("a_port"), F.col("ep_b.ip").alias("b_ip"), F.col("ep_b.port").alias("b_port"), "proto", "bucket", "session", "t_start", "t_end", "packets", "bytes", "anchor")


@query(f"WITH {FLOWS} SELECT a_ip, a_port, b_ip, b_port, proto, bucket, session, round(t_start, 4) AS t_start, round(t_end, 4) AS t_end, packets, bytes, anchor FROM fl")
def biflow_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).withColumns({"t_start": F.round("t_start", 4), "t_end": F.round("t_end", 4)})


@query(f"""WITH {FLOWS}, x AS (SELECT anchor || '@' || (bucket // 60) AS slice, CASE WHEN anchor = a_ip THEN b_ip ELSE a_ip END AS peer, CASE WHEN anchor = a_ip THEN b_port ELSE a_port END AS port, packets, bytes, t_start, t_end FROM fl WHERE anchor IS NOT NULL),
    y AS (SELECT slice, count(DISTINCT peer) AS peers, count(DISTINCT port) AS ports, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets, count(*) FILTER (peer LIKE '10.%') AS inside, count(*) FILTER (peer NOT LIKE '10.%') AS outside,
    count(*) FILTER (peer LIKE '10.%' AND port IN (22, 23, 135, 139, 445, 3389, 5985, 5986, 1433, 3306, 5432, 6379, 9200)) AS lateral_hits, bool_or(port IN (22, 23, 135, 139, 445, 3389, 5985, 5986, 1433, 3306, 5432, 6379, 9200)) AS "lateral",
    bool_or(port IN (137, 138, 139, 161, 445)) AS discovery, bool_or(port IN (53, 80, 443, 8080, 8443)) AS control, greatest(1e-6, max(t_end) - min(t_start)) AS lasts FROM x GROUP BY slice)
    SELECT slice, peers, ports, bytes, packets, inside, outside, lateral_hits, coalesce(nullif(concat_ws('|', CASE WHEN ((peers >= 20 OR ports >= 30) AND lasts <= 10) OR (discovery AND peers >= 5) THEN 'TA0007:Discovery' END,
    CASE WHEN lateral_hits >= 2 OR (inside >= 3 AND "lateral") THEN 'TA0008:LateralMovement' END, CASE WHEN outside >= 1 AND bytes >= 2000000 THEN 'TA0010:Exfiltration' END,
    CASE WHEN outside >= 1 AND peers <= 2 AND lasts >= 10 AND packets >= 10 AND control THEN 'TA0011:CommandAndControl' END), ''), 'TA0000:Benign') AS tactic FROM y""")
def slice_tactics(spark: SparkSession, d: str) -> DataFrame:
    """A2 over a minute of each anchor's flows."""
    f = _flows(spark, d).filter("anchor is not null")
    own = F.col("anchor") == F.col("a_ip")
    x = f.select(F.concat_ws("@", "anchor", F.floor(F.col("bucket") / 60).cast("string")).alias("slice"), "anchor", F.when(own, F.col("b_ip")).otherwise(F.col("a_ip")).alias("peer"), F.when(own, F.col("b_port")).otherwise(F.col("a_port")).alias("port"), "packets", "bytes", "t_start", "t_end")
    return flows.tactics(x).drop("lateral", "discovery", "control", "lasts")


@query(f"""WITH {ad.PACKETS} SELECT CASE WHEN dst_port = 53 THEN 'NET_DNS' WHEN dst_port IN (67, 68) THEN 'NET_DHCP' WHEN dst_port IN (80, 8080, 8000) THEN 'NET_CONNECT_HTTP' WHEN dst_port IN (443, 8443) THEN 'NET_CONNECT_HTTPS'
    WHEN dst_port = 22 THEN 'NET_CONNECT_SSH' WHEN dst_port = 3389 THEN 'NET_CONNECT_RDP' WHEN dst_port IN (445, 139) THEN 'NET_CONNECT_SMB' WHEN dst_port = 88 THEN 'NET_CONNECT_KRB' WHEN dst_port IN (389, 636) THEN 'NET_CONNECT_LDAP'
    ELSE 'NET_CONNECT_OTHER' END AS event_type, CASE WHEN bytes < 2000 THEN 'L' WHEN bytes < 200000 THEN 'M' ELSE 'H' END AS size,
    CASE WHEN dst_port <= 1023 THEN 'PORT_WELLKNOWN' WHEN dst_port <= 49151 THEN 'PORT_REGISTERED' ELSE 'PORT_DYNAMIC' END AS bucket, count(*) AS n FROM pk GROUP BY ALL""")
def network_event_types(spark: SparkSession, d: str) -> DataFrame:
    p = ad.packets(spark, d)
    return p.groupBy(rules.network_event(F.col("dst_port")).alias("event_type"), rules.magnitude(F.col("packet_len"), 2000, 200000).alias("size"), rules.port_bucket(F.col("dst_port")).alias("bucket")).agg(F.count("*").alias("n"))


_OF_FLOW = "a_ip, a_port, b_ip, b_port, proto, bucket, session"


@query(f"""WITH {FLOWS}, e AS (SELECT pc.*, event_type AS flag, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 3 = 0 THEN 'pvt' ELSE 'edge' END AS sensor FROM pc JOIN events ON event_id = packet_id),
    g AS (SELECT {_OF_FLOW}, flag, count(*) AS n, min((timestamp, packet_id)) AS first FROM e GROUP BY ALL), h AS (SELECT {_OF_FLOW}, sensor, count(*) AS n FROM e GROUP BY ALL),
    s AS (SELECT {_OF_FLOW}, string_agg(sensor || '=' || n, ',' ORDER BY sensor) AS sensors FROM h GROUP BY ALL)
    SELECT a_ip, a_port, b_ip, b_port, proto, CAST(bucket AS BIGINT) AS bucket, CAST(session AS BIGINT) AS session, string_agg(flag || '=' || n, ',' ORDER BY flag) AS counts, arg_min(flag, (-n, first)) AS top, any_value(sensors) AS sensors
    FROM g JOIN s USING ({_OF_FLOW}) GROUP BY {_OF_FLOW}""")
def flow_histograms(spark: SparkSession, d: str) -> DataFrame:
    """A1's histograms of flags (here the packets' event types) and sensors, and W6."""
    k = F.col("event_id")
    sensor = F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, "pvt").otherwise("edge")
    packets = ad.packets(spark, d).join(ad.table(spark, d, "events").select(k.alias("packet_id"), F.col("event_type").alias("flag"), sensor.alias("sensor")), "packet_id")
    told = lambda h, name: h.withColumn(name, F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","))
    flags, sensors = told(flows.histogram(packets, "flag"), "counts"), told(flows.histogram(packets, "sensor", missing="unknown"), "sensors")
    both = flags.join(sensors.drop("counts", "top"), flows.FLOW)
    return both.select(F.col("ep_a.ip").alias("a_ip"), F.col("ep_a.port").alias("a_port"), F.col("ep_b.ip").alias("b_ip"), F.col("ep_b.port").alias("b_port"), "proto", "bucket", F.col("session").cast("long").alias("session"), "counts", "top", "sensors")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n = 0 THEN 'NON_IP' WHEN n = 6 THEN 'TCP' WHEN n = 17 THEN 'UDP' ELSE 'IP_PROTO_' || n END AS protocol, CASE WHEN n IN (6, 17) THEN l_suppkey END AS src_port, CASE WHEN n = 6 THEN l_returnflag END AS flags
    FROM (SELECT *, CAST(l_quantity AS INTEGER) % 20 AS n FROM lineitem)""")
def packet_records(spark: SparkSession, d: str) -> DataFrame:
    """S7 over decoded header columns, here made from lineitem."""
    n = F.col("l_quantity").cast("int") % 20
    li = ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n != 0, n).alias("ip_proto"), F.col("l_suppkey").alias("src_port"), F.col("l_suppkey").alias("dst_port"), F.col("l_returnflag").alias("flags"))
    return normal.packet_records(li).select("l_orderkey", "l_linenumber", "protocol", "src_port", "flags")


@query("""SELECT coalesce(h, '') AS host_id, CASE WHEN h = '' THEN 'bad' WHEN h IN ('0201', '0402', '0501') THEN 'kept' ELSE 'other' END AS status, count(*) AS n
    FROM (SELECT lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS h FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT '' FROM customer WHERE c_custkey % 10 = 0) GROUP BY ALL""")
def host_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a host name (each tenth of another form), its number, and whether it is a target."""
    k = F.col("c_custkey")
    name = F.when(k % 10 == 0, F.concat(F.lit("other-"), k)).otherwise(F.concat(F.lit("sysclient"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(".systemia.com")))
    hosts = files.host_status(ad.table(spark, d, "customer").select(name.alias("hostname")), "hostname", ["0201", "0402", "0501"])
    return hosts.groupBy("host_id", "status").agg(F.count("*").alias("n"))


@query("""SELECT event_id, day, CASE day WHEN 'monday' THEN 0 WHEN 'tuesday' THEN 1 WHEN 'wednesday' THEN 2 WHEN 'thursday' THEN 3 WHEN 'friday' THEN 4 ELSE 999 END AS day_idx, coalesce(day, 'unknown') || ':' || event_id AS global_id
    FROM (SELECT event_id, CASE WHEN dayname(ts) IN ('Saturday', 'Sunday') THEN NULL ELSE lower(dayname(ts)) END AS day FROM events)""")
def day_merge(spark: SparkSession, d: str) -> DataFrame:
    e = ad.table(spark, d, "events").select("event_id", F.concat(F.lit("/week/"), F.date_format("ts", "EEEE"), F.lit("-packs.jsonl")).alias("source_file"))
    return files.merge_days(e, "source_file", "event_id").select("event_id", "day", "day_idx", "global_id")


TARGETS = """n AS (SELECT coalesce(nullif(lang, ''), 'UNK') AS stratum, count(*) AS n FROM documents GROUP BY ALL),
    t1 AS (SELECT *, CAST(round_even(n * 0.7, 0) AS BIGINT) AS a, CASE WHEN n >= 3 AND round_even(n * 0.1, 0) < 1 THEN 1 ELSE CAST(round_even(n * 0.1, 0) AS BIGINT) END AS n_val FROM n),
    t2 AS (SELECT *, least(a, n - n_val) AS a2 FROM t1), tg AS (SELECT stratum, n, CASE WHEN n >= 3 AND n - a2 - n_val < 1 THEN n - n_val - 1 ELSE a2 END AS n_train, n_val FROM t2)"""


@query(f"""WITH {TARGETS.replace("FROM documents GROUP BY ALL", "FROM (SELECT coalesce(nullif(lang, ''), 'UNK') || '|' || coalesce(nullif(source, ''), 'unknown') AS lang FROM documents) GROUP BY ALL")}
    SELECT *, n - n_train - n_val AS n_test FROM tg""")
def split_targets_strength(spark: SparkSession, d: str) -> DataFrame:
    """P20 with a strength: quotas by label and strength (here language and source)."""
    docs = ad.table(spark, d, "documents").withColumn("key", splits.stratum_key("lang", "source"))
    return splits.quota_targets(docs, "key")


@query(f"WITH {TARGETS} SELECT *, n - n_train - n_val AS n_test FROM tg")
def split_targets(spark: SparkSession, d: str) -> DataFrame:
    return splits.quota_targets(ad.table(spark, d, "documents"), "lang")


QUOTA_SPLIT = f"""{TARGETS}, u AS (SELECT doc_id, coalesce(nullif(lang, ''), 'UNK') AS stratum, CAST(('0x' || sha1('42||' || doc_id)[1:16])::UBIGINT % 1000000000000 AS DOUBLE) / 1e12 AS u FROM documents),
    o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY doc_id) AS rn FROM u),
    g AS (SELECT stratum, 0::BIGINT AS rn, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, NULL::BIGINT AS doc_id, NULL::DOUBLE AS u, -1 AS x FROM tg
        UNION ALL SELECT stratum, rn, a + (x = 0)::BIGINT, b + (x = 1)::BIGINT, c + (x = 2)::BIGINT, doc_id, u, x FROM (SELECT o.stratum, o.rn, a, b, c, o.doc_id, o.u,
        CASE WHEN o.u < 1.0 / 3 THEN CASE WHEN a < n_train THEN 0 WHEN b < n_val THEN 1 ELSE 2 END WHEN o.u < 2.0 / 3 THEN CASE WHEN b < n_val THEN 1 WHEN a < n_train THEN 0 ELSE 2 END
        ELSE CASE WHEN c < n - n_train - n_val THEN 2 WHEN a < n_train THEN 0 ELSE 1 END END AS x FROM g JOIN o ON o.stratum = g.stratum AND o.rn = g.rn + 1 JOIN tg ON tg.stratum = o.stratum)),
    sp AS (SELECT doc_id, stratum, u, CASE x WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM g WHERE x >= 0)"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.table(spark, d, "documents").select("doc_id", "lang", "source")
    return splits.quota_split(docs, "lang", "doc_id", F.floor(F.col("doc_id") / 4096), ["doc_id"])


@query(f"WITH RECURSIVE {QUOTA_SPLIT} SELECT doc_id, stratum, u, split FROM sp")
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("doc_id", "stratum", "u", "split")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CASE WHEN place < floor(n * 0.7) THEN 'train' WHEN place < floor(n * 0.7) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""")
def split_time(spark: SparkSession, d: str) -> DataFrame:
    return splits.time_split(ad.table(spark, d, "orders"), F.to_date("o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


@query(f"""WITH RECURSIVE {QUOTA_SPLIT}, l AS (SELECT split, source AS label FROM sp JOIN documents USING (doc_id))
    SELECT label, s.split, count(l.split) AS n FROM (SELECT DISTINCT label FROM l) CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN l USING (label, split) GROUP BY ALL""")
def split_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(_split(spark, d), "source")


@query(f"""WITH RECURSIVE {QUOTA_SPLIT}, l AS (SELECT split, text AS label, sp.doc_id FROM sp JOIN documents USING (doc_id)), k AS (SELECT label, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM l WHERE label IS NOT NULL GROUP BY label)
    SELECT count(*) FILTER (NOT a) AS unknown, count(*) FILTER (a AND b) AS train_val, count(*) FILTER (a AND c) AS train_test, count(*) FILTER (b AND c) AS val_test FROM k""")
def split_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of the documents' different texts, those that train doesn't have, and those that two splits share."""
    rows = _split(spark, d).select("doc_id", "split").join(ad.table(spark, d, "documents").select("doc_id", "text").filter("text is not null"), "doc_id").select("split", F.sha2("text", 256).alias("label"))
    unknown = splits.unknown_labels(rows, "label").agg(F.count("*").alias("unknown"))
    n = lambda a, b: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("n"))).alias(f"{a}_{b}")
    shared = splits.split_overlap(rows, "label").agg(n("train", "val"), n("train", "test"), n("val", "test"))
    return unknown.crossJoin(shared)  # one row each


@query(f"WITH {ad.MEMBERS} SELECT * FROM nn")
def hg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return hypergraph.nodes(ad.members(spark, d))


@query(f"WITH {ad.MEMBERS} SELECT * FROM ic")
def hg_incidence(spark: SparkSession, d: str) -> DataFrame:
    m = ad.members(spark, d)
    return hypergraph.incidence(m, hypergraph.nodes(m))


@query("""SELECT l_orderkey AS hid, count(*) AS total_count, count(DISTINCT l_partkey) AS num_entities, count(DISTINCT l_returnflag) AS num_events, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY ALL""")
def hg_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hid"), F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("event"), F.col("l_discount").alias("score"))
    return hypergraph.edge_attributes(rows).withColumn("score", F.round("score", 6))


@query(f"WITH {ad.MEMBERS} SELECT node_id, count(*) AS degree, round(ln(1 + count(*)), 6) AS log_degree FROM ic GROUP BY node_id")
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    m = ad.members(spark, d)
    return hypergraph.degrees(hypergraph.incidence(m, hypergraph.nodes(m))).withColumn("log_degree", F.round(F.log1p("degree"), 6))


@query(f"""WITH {ad.MEMBERS}, t AS (SELECT node_id, unnest(list_filter(regexp_split_to_array(lower(token), '[^\\p{{L}}\\p{{N}}._:-]+'), lambda x: x <> '')) AS w FROM nn)
    SELECT node_id, CAST(('0x' || md5(w)[1:8])::UBIGINT % 64 AS INTEGER) AS idx, CAST(count(*) AS DOUBLE) AS val FROM t GROUP BY ALL""")
def node_features(spark: SparkSession, d: str) -> DataFrame:
    return hypergraph.token_features(hypergraph.nodes(ad.members(spark, d)))


@query("SELECT l_orderkey AS hid, CAST(('0x' || md5(l_returnflag)[1:8])::UBIGINT % 128 AS INTEGER) AS idx, CAST(count(*) AS DOUBLE) AS val FROM lineitem GROUP BY ALL")
def edge_features(spark: SparkSession, d: str) -> DataFrame:
    return hypergraph.event_features(ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hid"), F.col("l_returnflag").alias("event")))


@query(f"WITH {ad.HOP} SELECT target, hid, depth FROM sm")
def khop_edges(spark: SparkSession, d: str) -> DataFrame:
    """G5, one hop, hubs sampled for each target."""
    m = ad.members(spark, d)
    inc = ordered.written(hypergraph.incidence(m, hypergraph.nodes(m)))
    return hypergraph.subgraphs(inc, 1, keep=False)["sub_edges"].select("target", "hid", "depth")


@query(f"""WITH {ad.MEMBERS}, v AS (SELECT node_id, 0 AS idx, CAST(1 + node_id % 5 AS DOUBLE) AS val FROM nn), e AS (SELECT hid, avg(val) AS m FROM ic JOIN v USING (node_id) GROUP BY hid)
    SELECT v.node_id, v.idx, round(v.val + avg(e.m), 6) AS val FROM v JOIN ic USING (node_id) JOIN e USING (hid) GROUP BY v.node_id, v.idx, v.val""")
def propagate_mean(spark: SparkSession, d: str) -> DataFrame:
    m = ad.members(spark, d)
    n = ordered.written(hypergraph.nodes(m))
    values = n.select("node_id", F.lit(0).alias("idx"), (1 + F.col("node_id") % 5).cast("double").alias("val"))
    return hypergraph.propagate_mean(ordered.written(hypergraph.incidence(m, n)), values).withColumn("val", F.round("val", 6))


@query("""WITH n AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL) SELECT label, n, round(n / sum(n) OVER (), 8) AS prior, round(ln(n / sum(n) OVER ()), 6) AS log_prior, 1.0::DOUBLE AS w_none,
    round((1.0 / n) / avg(1.0 / n) OVER (), 6) AS w_inv, round((1 / sqrt(n)) / avg(1 / sqrt(n)) OVER (), 6) AS w_sqrt, round((0.001 / (1 - power(0.999, n))) / avg(0.001 / (1 - power(0.999, n))) OVER (), 6) AS w_eff FROM n""")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    w = scoring.class_weights(ad.table(spark, d, "orders"), "o_orderpriority")
    return w.select("label", "n", F.round("prior", 8).alias("prior"), *[F.round(c, 6).alias(c) for c in ("log_prior", "w_none", "w_inv", "w_sqrt", "w_eff")])


@query(f"WITH {ad.SCORES} SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(val, 6) AS val FROM pp")
def prototypes(spark: SparkSession, d: str) -> DataFrame:
    return scoring.prototypes(ad.vectors(spark, d)).withColumn("val", F.round("val", 6))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    v = ad.vectors(spark, d)
    return scoring.prototype_scores(v, scoring.prototypes(v))


@query(f"WITH {ad.SCORES} SELECT id, y, label, round(logit, 5) AS logit, round(p, 5) AS p FROM sc")
def proto_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumns({"logit": F.round("logit", 5), "p": F.round("p", 5)})


@query(f"WITH {ad.SCORES} SELECT id, y, pred, array_to_string(all_labels[1:3], ',') AS top, round(anomaly, 5) AS anomaly, anomaly_type FROM pr")
def proto_predict(spark: SparkSession, d: str) -> DataFrame:
    p = scoring.predictions(_scores(spark, d))
    return p.select("id", "y", "pred", F.array_join("top", ",").alias("top"), F.round("anomaly", 5).alias("anomaly"), "anomaly_type")


@query(f"WITH {ad.SCORES} SELECT y, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 8) AS share FROM pr GROUP BY y, pred")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(scoring.predictions(_scores(spark, d))).withColumn("share", F.round("share", 8))


@query(f"""WITH {ad.SCORES}, a AS (SELECT y AS c, count(*) AS pos, count(*) FILTER (y = pred) AS tp FROM pr GROUP BY y), b AS (SELECT pred AS c, count(*) AS said FROM pr GROUP BY pred),
    m AS (SELECT coalesce(tp, 0) AS tp, coalesce(pos, 0) AS pos, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(pos, 0), 0) AS r FROM a FULL JOIN b USING (c))
    SELECT round(sum(tp) / sum(pos), 8) AS accuracy, round(avg(p), 8) AS "precision", round(avg(r), 8) AS recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 8) AS f1 FROM m""")
def macro_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.macro_metrics(metrics.confusion(scoring.predictions(_scores(spark, d))))
    return m.select(*[F.round(c, 8).alias(c) for c in m.columns])


@query(f"WITH {ad.SCORES} SELECT CAST(count(*) FILTER (list_contains(all_labels[1:3], y)) AS DOUBLE) / count(*) AS top3, CAST(count(*) FILTER (list_contains(all_labels[1:5], y)) AS DOUBLE) / count(*) AS top5 FROM pr")
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    p = scoring.predictions(_scores(spark, d), k=5)
    return p.agg(*[F.avg(F.array_contains(F.slice("top", 1, k), F.col("y")).cast("double")).alias(f"top{k}") for k in (3, 5)])


RANKED = f"""{ad.SCORES}, hs AS (SELECT label, round(p, 5) AS score, CASE WHEN y = label THEN 1 ELSE 0 END AS hit FROM sc), hg AS (SELECT label, score, sum(hit) AS p, count(*) AS n FROM hs GROUP BY ALL),
    hc AS (SELECT *, n - p AS neg, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM hg WINDOW w AS (PARTITION BY label ORDER BY score DESC))"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("label", F.round("p", 5).alias("score"), (F.col("y") == F.col("label")).cast("int").alias("hit"))


@query(f"WITH {RANKED} SELECT label, round(sum(neg * (cp - p / 2)) / nullif(sum(p) * sum(neg), 0), 8) AS auc FROM hc GROUP BY label")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(_hits(spark, d)).withColumn("auc", F.round("auc", 8))


@query(f"WITH {RANKED} SELECT label, round(sum(p * cp / cn) / nullif(sum(p), 0), 8) AS ap FROM hc GROUP BY label")
def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_hits(spark, d)).withColumn("ap", F.round("ap", 8))


@query(f"""WITH {ad.SCORES}, a AS (SELECT CAST(floor(round(anomaly, 5) * 1000 + 1e-9) AS INTEGER) AS i, CASE WHEN y <> 0 THEN 1 ELSE 0 END AS hit FROM pr), h AS (SELECT i, sum(hit) AS p, count(*) AS n FROM a GROUP BY i),
    c AS (SELECT i, sum(p) OVER w AS tp, sum(n) OVER w AS said, sum(p) OVER () AS pos FROM h WINDOW w AS (ORDER BY i DESC))
    SELECT i / 1000 AS tau, round(2 * tp / nullif(said + pos, 0), 8) AS f1 FROM c ORDER BY 2 DESC, i LIMIT 1""")
def best_tau(spark: SparkSession, d: str) -> DataFrame:
    p = scoring.predictions(_scores(spark, d)).select(F.round("anomaly", 5).alias("score"), (F.col("y") != 0).cast("int").alias("hit"))
    return metrics.best_threshold(p).withColumn("f1", F.round("f1", 8))


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 50")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return scoring.quota_sample(ad.table(spark, d, "orders"), "o_orderpriority", "o_orderkey", 50, 7).select("o_orderkey", "o_orderpriority")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}._:-]+'), lambda x: x <> '')[1:300] AS t FROM documents),
    x AS (SELECT doc_id, unnest(t) AS w FROM w) SELECT doc_id, CAST(('0x' || md5(w)[1:8])::UBIGINT % 64 AS INTEGER) AS idx, CAST(count(*) AS DOUBLE) AS val FROM x GROUP BY ALL""")
def hashed_bags(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("token"))
    return hypergraph.token_features(docs).withColumnRenamed("node_id", "doc_id")


#: File names by an object's last digit, from which the technique rules tell techniques.
_FILES = ("firefox", "drakon", "bash", "ping", "cmd.exe", "powershell", "notes", "mimikatz", "ls", "sysinfo")
_TTPS = ("T1189", "T1055", "", "T1016", "T1059.003", "T1059.001", "", "T1003", "", "T1082")
#: Seeds of the labels of event slices.
_SEEDS = {"Access": ("EVENT_SIGNUP", "TTP_T1189", "TTP_T1003"), "Discovery": ("EVENT_VIEW", "TTP_T1016", "TTP_T1082"), "Execution": ("EVENT_CLICK", "TTP_T1055", "TTP_T1059.001", "TTP_T1059.003"), "Impact": ("EVENT_ERROR", "EVENT_PURCHASE")}
_SEED_ROWS = ", ".join(f"('{w}', '{label}', {i}, {len(s)})" for i, (label, s) in enumerate(_SEEDS.items()) for w in s)
_TTP_LIST = ", ".join(f"'{t}'" for t in _TTPS)
PACKS = f"""{SLICED}, st AS (SELECT *, ([{_TTP_LIST}])[CAST(o[2:] AS INTEGER) + 1] AS ttp FROM sl),
    r AS (SELECT stream, slice_id, t_ns, seq, etype, o, ttp, CASE WHEN lag(etype) OVER w IS DISTINCT FROM etype THEN 1 ELSE 0 END AS new FROM st WINDOW w AS (PARTITION BY stream, slice_id ORDER BY t_ns, seq)),
    m AS (SELECT *, sum(new) OVER (PARTITION BY stream, slice_id ORDER BY t_ns, seq) AS run FROM r),
    tw AS (SELECT stream, slice_id, word, count(*)::DOUBLE AS n FROM (SELECT stream, slice_id, etype AS word FROM st UNION ALL SELECT stream, slice_id, 'TTP_' || ttp FROM st WHERE ttp <> '') GROUP BY ALL),
    tn AS (SELECT stream, slice_id, sqrt(sum(n * n)) AS norm FROM tw GROUP BY ALL), sd AS (SELECT * FROM (VALUES {_SEED_ROWS}) AS v(word, label, place, size)),
    ls AS (SELECT stream, slice_id, label, place, coalesce(sum(n), 0) / any_value(norm) / sqrt(any_value(size)) AS sim FROM (SELECT tn.*, sd.*, tw.n FROM tn JOIN sd ON TRUE LEFT JOIN tw ON tw.stream = tn.stream AND tw.slice_id = tn.slice_id AND tw.word = sd.word) GROUP BY ALL),
    lb AS (SELECT stream, slice_id, first(label ORDER BY round(sim, 12) DESC, place) AS label, round(max(sim), 6) AS score FROM ls GROUP BY ALL),
    he AS (SELECT stream, slice_id, min(t_ns) AS t_start, count(*) AS total_count, count(DISTINCT o) AS num_entities, count(DISTINCT etype) AS num_events, coalesce(first(ttp ORDER BY t_ns, seq) FILTER (ttp <> ''), '') AS ttp FROM m GROUP BY ALL),
    hn AS (SELECT he.*, lb.label, lb.score, row_number() OVER (ORDER BY t_start, stream, slice_id) - 1 AS hid, dense_rank() OVER (ORDER BY lb.label) - 1 AS y FROM he JOIN lb USING (stream, slice_id)),
    ev2 AS (SELECT hid, etype, count(*)::DOUBLE AS n FROM m JOIN hn USING (stream, slice_id) GROUP BY ALL),
    tq AS (SELECT hid, m.ttp, count(DISTINCT run)::DOUBLE AS n FROM m JOIN hn USING (stream, slice_id) WHERE m.ttp <> '' GROUP BY ALL),
    pm AS (SELECT DISTINCT hid, token, type FROM (SELECT hid, o AS token, 'entity' AS type FROM m JOIN hn USING (stream, slice_id) UNION ALL SELECT hid, 'EVT:' || etype, 'event' FROM m JOIN hn USING (stream, slice_id))),
    pf AS (SELECT token, min(hid * 2 + CASE WHEN type = 'entity' THEN 0 ELSE 1 END) AS f FROM pm GROUP BY token),
    pn AS (SELECT row_number() OVER (ORDER BY f, token) - 1 AS node_id, token, CASE WHEN f % 2 = 0 THEN 'entity' ELSE 'event' END AS type FROM pf),
    pi AS (SELECT pn.node_id, pm.hid FROM pm JOIN pn USING (token))"""


def _event_packs(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*[F.lit(f"/bin/{x}") for x in _FILES]), F.substring("o", 2, 9).cast("int"))
    sliced = slicing.slice_events(ad.events(spark, d), ad.GAP_NS).withColumn("ttp", rules.technique(name))
    return packs.event_packs(sliced, _SEEDS)


def _packs(spark: SparkSession, d: str, number: bool = True) -> dict[str, DataFrame]:
    """The event slices as packs, and their hypergraph."""
    return hypergraph.from_packs(_event_packs(spark, d), F.floor(F.col("t_start") / 10**13), ["t_start", "stream", "slice_id"], number)


def _listed(pairs: Column) -> Column:
    """A map of numbers as k=v text in order of keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("long").cast("string"))), ",")


@query(f"""WITH {PACKS} SELECT stream, slice_id, t_start, hn.label AS semantic_label, hn.score AS semantic_score, hn.ttp, (SELECT string_agg(x, ';' ORDER BY run) FROM
    (SELECT run, any_value(etype) || '*' || count(*) || ':' || string_agg(o, '>' ORDER BY t_ns, seq) || ':' || coalesce(string_agg(DISTINCT nullif(m.ttp, ''), '+' ORDER BY nullif(m.ttp, '')), '') AS x FROM m WHERE m.stream = hn.stream AND m.slice_id = hn.slice_id GROUP BY run)) AS motifs FROM hn""")
def event_packs(spark: SparkSession, d: str) -> DataFrame:
    """Event slices as packs, motifs written as event*count:entities:techniques."""
    text = F.transform("motifs", lambda m: F.concat(m["event_type"], F.lit("*"), m["count"].cast("string"), F.lit(":"), F.array_join(m["entities"], ">"), F.lit(":"), F.array_join(m["techniques"], "+")))
    return _event_packs(spark, d).withColumn("motifs", F.array_join(text, ";"))


@query(f"""WITH {PACKS} SELECT hid, y, label AS semantic_label, total_count, num_entities, num_events, score AS attr_score, total_count::DOUBLE AS attr_count, num_entities::DOUBLE AS attr_entities,
    (SELECT string_agg(etype || '=' || n::BIGINT, ',' ORDER BY etype) FROM ev2 WHERE ev2.hid = hn.hid) AS event_types, coalesce((SELECT string_agg(ttp || '=' || n::BIGINT, ',' ORDER BY ttp) FROM tq WHERE tq.hid = hn.hid), '') AS techniques FROM hn""")
def pack_hyperedges(spark: SparkSession, d: str) -> DataFrame:
    e = _packs(spark, d)["hyperedges"]
    at = lambda i, name: F.get("edge_attr", F.lit(i)).alias(name)
    return e.select("hid", "y", "semantic_label", "total_count", "num_entities", "num_events", at(0, "attr_score"), at(1, "attr_count"), at(2, "attr_entities"), _listed(F.col("event_types")).alias("event_types"), _listed(F.col("techniques")).alias("techniques"))


@query(f"WITH {PACKS} SELECT hid, node_id, token, type FROM pi JOIN pn USING (node_id)")
def pack_incidence(spark: SparkSession, d: str) -> DataFrame:
    """From events to the incidence table."""
    t = _packs(spark, d)
    return t["incidence"].join(t["nodes"], "node_id").select("hid", "node_id", "token", "type")


def _filled(vectors: DataFrame, key: str) -> DataFrame:
    """(key, pos, val) of the numbers that aren't 0."""
    return vectors.select(key, F.posexplode("vec").alias("pos", "val")).filter("val <> 0").withColumn("val", F.round("val", 6))


_SLOT = "CAST(('0x' || md5({0})[1:8])::UBIGINT % {1} AS INTEGER)"


@query(f"""WITH {PACKS}, dg AS (SELECT node_id, count(*) AS n FROM pi GROUP BY node_id), wd AS (SELECT node_id, unnest(list_filter(regexp_split_to_array(lower(token), '[^\\p{{L}}\\p{{N}}._:-]+'), lambda x: x <> '')) AS w FROM pn),
    al AS (SELECT node_id, CASE WHEN type = 'event' THEN 1 ELSE 0 END AS pos, 1.0::DOUBLE AS val FROM pn UNION ALL SELECT node_id, 2, ln(1 + n) FROM dg UNION ALL SELECT node_id, 3, n / (SELECT count(*) FROM hn) FROM dg UNION ALL SELECT node_id, 4, 1.0 FROM dg
        UNION ALL SELECT node_id, 5 + {_SLOT.format('w', 64)}, count(*)::DOUBLE FROM wd GROUP BY ALL) SELECT node_id, CAST(pos AS INTEGER) AS pos, round(val, 6) AS val FROM al""")
def node_vectors(spark: SparkSession, d: str) -> DataFrame:
    """G3's whole vectors, by position."""
    t = _packs(spark, d)
    return _filled(hypergraph.node_vectors(t["nodes"], t["incidence"], total=t["hyperedges"].count()), "node_id")


@query(f"""WITH {PACKS}, al AS (SELECT hid, 0 AS pos, score AS val FROM hn UNION ALL SELECT hid, 1, (num_entities + num_events)::DOUBLE FROM hn UNION ALL SELECT hid, 2, num_events::DOUBLE FROM hn UNION ALL SELECT hid, 3, count(*)::DOUBLE FROM tq GROUP BY hid
        UNION ALL SELECT hid, 4 + {_SLOT.format('etype', 128)}, sum(n) FROM ev2 GROUP BY ALL UNION ALL SELECT hid, 132 + {_SLOT.format('ttp', 128)}, sum(n) FROM tq GROUP BY ALL)
    SELECT hid, CAST(pos AS INTEGER) AS pos, round(val, 6) AS val FROM al WHERE val <> 0""")
def edge_vectors(spark: SparkSession, d: str) -> DataFrame:
    """G4's whole vectors, by position."""
    t = _packs(spark, d, number=False)
    return _filled(hypergraph.edge_vectors(ordered.written(t["hyperedges"]), t["members"]), "hid")


@query()
def khop_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of two hops with all caps, as (target, edges, nodes, links)."""
    m = ad.members(spark, d)
    inc = ordered.written(hypergraph.incidence(m, hypergraph.nodes(m)))
    return hypergraph.subgraphs(inc, sizes=True)["sub_sizes"]


@query(f"""WITH {ad.SCORES}, a AS (SELECT y, anomaly >= 0.5 AS hit, y <> 0 AS real FROM pr) SELECT round(coalesce(count(*) FILTER (hit AND real) / nullif(count(*) FILTER (hit), 0), 0), 8) AS "precision",
    round(coalesce(count(*) FILTER (hit AND real) / nullif(count(*) FILTER (real), 0), 0), 8) AS recall, round(coalesce(2 * count(*) FILTER (hit AND real) / nullif(count(*) FILTER (hit) + count(*) FILTER (real), 0), 0), 8) AS f1,
    (SELECT round(sum(p * cp / cn) / nullif(sum(p), 0), 8) FROM (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM (SELECT round(anomaly, 5) AS s, count(*) FILTER (y <> 0) AS p, count(*) AS n FROM pr GROUP BY s) WINDOW w AS (ORDER BY s DESC))) AS ap FROM a""")
def anomaly_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = scoring.anomaly_metrics(scoring.anomaly_export(scoring.predictions(_scores(spark, d)), 0.5).withColumn("anomaly", F.round("anomaly", 5)))
    return m.select(*[F.round(c, 8).alias(c) for c in m.columns])


@query(f"""WITH {ad.SCORES}, pl AS (SELECT y AS label, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM vx WHERE pos = 1 GROUP BY y), al AS (SELECT id, sc.label, logit + 0.5 * lp AS logit FROM sc JOIN pl USING (label))
    SELECT id, label, round(logit, 5) AS logit, round(exp(logit - max(logit) OVER w) / sum(exp(logit - mx)) OVER w, 5) AS p FROM (SELECT *, max(logit) OVER (PARTITION BY id) AS mx FROM al) WINDOW w AS (PARTITION BY id)""")
def adjusted_scores(spark: SparkSession, d: str) -> DataFrame:
    a = scoring.adjusted(_scores(spark, d), scoring.class_weights(ad.vectors(spark, d), "label"), 0.5)
    return a.select("id", "label", F.round("logit", 5).alias("logit"), F.round("p", 5).alias("p"))


@query("""WITH n AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL), x AS (SELECT label, n, n / sum(n) OVER () * 1003 AS x FROM n),
    q AS (SELECT *, 1003 - sum(floor(x)) OVER () AS need, row_number() OVER (ORDER BY x - floor(x) DESC, label) AS rank FROM x) SELECT label, CAST(floor(x) + CASE WHEN rank <= need THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q""")
def quota_alloc(spark: SparkSession, d: str) -> DataFrame:
    return scoring.quota_alloc(scoring.class_weights(ad.table(spark, d, "orders"), "o_orderpriority"), "n", 1003)


@query("""WITH RECURSIVE n AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL), x AS (SELECT label, n / sum(n) OVER () * 1003 AS x, CASE label WHEN '5-LOW' THEN 420 WHEN '1-URGENT' THEN 150 ELSE 0 END AS low FROM n),
    q AS (SELECT label, low, CAST(greatest(floor(x), low) AS BIGINT) AS q FROM x), o AS (SELECT *, row_number() OVER (ORDER BY q DESC, label) AS i FROM q),
    t AS (SELECT 0::BIGINT AS i, (SELECT sum(q)::BIGINT - 1003 FROM q) AS extra, NULL::VARCHAR AS label, 0::BIGINT AS quota
        UNION ALL SELECT o.i, t.extra - least(t.extra, o.q - o.low), o.label, o.q - least(t.extra, o.q - o.low) FROM t JOIN o ON o.i = t.i + 1)
    SELECT label, quota FROM t WHERE i > 0""")
def quota_take_back(spark: SparkSession, d: str) -> DataFrame:
    """G16 where floors ask for more than there is: the largest quotas give way first."""
    sizes = ad.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    return scoring.quota_alloc(sizes, "n", 1003, {"5-LOW": 420, "1-URGENT": 150}, size="n")


@query(f"""WITH {ad.SCORES}, ex AS (SELECT id, first(y) AS y, list(label ORDER BY logit DESC, label) AS labels, list(round(p, 5) ORDER BY logit DESC, label) AS probs, list(round(p, 5) ORDER BY label) AS every, 1 - sum(CASE WHEN label = 2 THEN p ELSE 0 END) AS anomaly,
    first(label ORDER BY logit DESC, label) FILTER (label <> 2) AS other FROM sc GROUP BY id)
    SELECT id, y, labels[1] AS pred, round(anomaly, 5) AS anomaly, anomaly >= 0.9 AS is_anomaly, CASE WHEN anomaly >= 0.9 THEN CAST(other AS VARCHAR) ELSE 'None' END AS anomaly_type,
    list_aggregate(labels[1:3], 'string_agg', ',') AS top_labels, round(probs[1], 5) AS top1_prob, round(probs[3], 5) AS top3_prob, len(every) AS classes, round(every[1], 5) AS p_first, round(every[-1], 5) AS p_last FROM ex""")
def prediction_export(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with the top classes' and every class's probability, label 2 as the benign one."""
    e = scoring.prediction_export(_scores(spark, d), 0.9, 3, 2)
    at = lambda c, i: F.round(F.try_element_at(c, F.lit(i)), 5)
    return e.select(
        "id", "y", "pred", F.round("anomaly", 5).alias("anomaly"), "is_anomaly", "anomaly_type", F.array_join(F.col("top").cast("array<string>"), ",").alias("top_labels"), at("top_p", 1).alias("top1_prob"), at("top_p", 3).alias("top3_prob"),
        F.size("p").cast("long").alias("classes"), at("p", 1).alias("p_first"), at("p", -1).alias("p_last"),
    )
