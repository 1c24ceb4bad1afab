"""Registered queries of flow slices, their chains, motifs, labels and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules
from ..operators import flows, flowslices, ordered, semantics
from . import adapters as ad, queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
GAP_S, IDLE_S, SALT = 3.0, 1.0, "salt"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _sliced(spark: SparkSession, d: str) -> DataFrame:
    packets = ad.packets(spark, d)
    f = flows.biflows(packets, IDLE_S, IDLE_S)
    flat = f.select(F.col("ep_a.ip").alias("a_ip"), F.col("ep_a.port").alias("a_port"), F.col("ep_b.ip").alias("b_ip"), F.col("ep_b.port").alias("b_port"), "proto", "bucket", "session", "t_start", "t_end", "packets", "bytes", "anchor")
    one = F.lit("f").alias("stream")
    ordered = flowslices.emission_order(flat.select("*", one), packets.select(one, "timestamp"), IDLE_S)
    return flowslices.flow_slices(ordered, GAP_S)


#: One row of state a step: fo are the flows in the order of emission, fs the slice that is open after each.
_WALK = f"""WITH RECURSIVE {queries.FLOWS}, px AS (SELECT DISTINCT timestamp AS t FROM pk), fx AS (SELECT fl.*, px.t AS expiry FROM fl ASOF LEFT JOIN px ON px.t > fl.t_end + {IDLE_S}),
    fo AS (SELECT *, a_ip LIKE '10.%' AND b_ip LIKE '10.%' AS inr, row_number() OVER (ORDER BY expiry NULLS LAST, t_start, a_ip, a_port, b_ip, b_port, proto, bucket, session) AS e FROM fx WHERE anchor IS NOT NULL),
    fs AS (SELECT 0::BIGINT AS e, NULL::DOUBLE AS last, NULL::VARCHAR AS own, NULL::VARCHAR AS oth, -1::BIGINT AS slice_id
        UNION ALL SELECT e, t_start, own2, CASE WHEN inr THEN CASE WHEN b_ip = own2 THEN a_ip ELSE b_ip END WHEN joins THEN oth END, slice_id + CASE WHEN joins THEN 0 ELSE 1 END
        FROM (SELECT *, CASE WHEN joins THEN own ELSE anchor END AS own2 FROM (SELECT fo.e, fo.t_start, fo.anchor, fo.a_ip, fo.b_ip, fo.inr, fs.own, fs.oth, fs.slice_id, coalesce(fo.t_start - fs.last <= {GAP_S} AND (fo.anchor = fs.own OR fo.anchor = fs.oth), FALSE) AS joins FROM fs JOIN fo ON fo.e = fs.e + 1)))"""
SQL["flow_slices"] = f"""{_WALK}
    SELECT 'f' AS stream, fs.slice_id, any_value(fs.own) AS slice_anchor, round(min(fo.t_start), 4) AS t_start, round(max(fo.t_end), 4) AS t_end, count(*) AS flows_count FROM fs JOIN fo USING (e) GROUP BY fs.slice_id"""
_PORTS = {"lat": flows.LATERAL, "disc": flows.DISCOVERY, "ctl": flows.CONTROL}
_IN = {k: f"port IN {v}" for k, v in _PORTS.items()}
SQL["flow_tactics"] = f"""{_WALK}, x AS (SELECT fs.slice_id, CASE fs.own WHEN a_ip THEN b_ip WHEN b_ip THEN a_ip END AS peer, CASE fs.own WHEN a_ip THEN b_port WHEN b_ip THEN a_port END AS port, packets, bytes, t_start, t_end FROM fs JOIN fo USING (e)),
    y AS (SELECT slice_id, count(DISTINCT peer) AS peers, count(DISTINCT port) AS ports, coalesce(sum(bytes) FILTER (peer IS NOT NULL), 0) AS bytes, coalesce(sum(packets) FILTER (peer IS NOT NULL), 0) AS packets, count(*) FILTER (peer LIKE '10.%') AS inside, count(*) FILTER (peer NOT LIKE '10.%') AS outside,
        count(*) FILTER (peer LIKE '10.%' AND {_IN['lat']}) AS hits, coalesce(bool_or({_IN['lat']}), FALSE) AS lat, coalesce(bool_or({_IN['disc']}), FALSE) AS disc, coalesce(bool_or({_IN['ctl']}), FALSE) AS ctl, greatest(1e-6, max(t_end) - min(t_start)) AS lasts FROM x GROUP BY slice_id)
    SELECT 'f:' || slice_id AS slice, coalesce(nullif(concat_ws('|', CASE WHEN ((peers >= 20 OR ports >= 30) AND lasts <= 10) OR (disc AND peers >= 5) THEN 'TA0007:Discovery' END, CASE WHEN hits >= 2 OR (inside >= 3 AND lat) THEN 'TA0008:LateralMovement' END,
        CASE WHEN outside >= 1 AND bytes >= 2000000 THEN 'TA0010:Exfiltration' END, CASE WHEN outside >= 1 AND peers <= 2 AND lasts >= 10 AND packets >= 10 AND ctl THEN 'TA0011:CommandAndControl' END), ''), 'TA0000:Benign') AS tactic FROM y"""


#: The walk through each slice's flows: where it stands before flow i, and the steps that the flow adds.
_CHAIN = f"""{_WALK}, fr AS (SELECT fs.slice_id, fs.own AS anchor, fo.*, row_number() OVER (PARTITION BY fs.slice_id ORDER BY fo.t_start, fo.e) AS i FROM fs JOIN fo USING (e)),
    w AS (SELECT slice_id, 0::BIGINT AS i, any_value(anchor) AS host, [any_value(anchor)] AS seen, 1::BIGINT AS step, NULL::BIGINT AS f_step, NULL::VARCHAR AS was, NULL::VARCHAR AS peer, NULL::INTEGER AS port, NULL::VARCHAR AS proto, 1::BIGINT AS h_step FROM fr GROUP BY slice_id
        UNION ALL SELECT slice_id, i, CASE WHEN moves THEN peer ELSE host END, CASE WHEN moves THEN list_append(seen, peer) ELSE seen END, step + touches::INTEGER + moves::INTEGER, CASE WHEN touches THEN step + 1 END, host, peer, port, proto, CASE WHEN moves THEN step + 2 END
        FROM (SELECT *, touches AND peer LIKE '10.%' AND NOT list_contains(seen, peer) AS moves FROM (SELECT w.slice_id, fr.i, w.host, w.seen, w.step, fr.proto, w.host IN (fr.a_ip, fr.b_ip) AS touches,
            CASE WHEN fr.a_ip = w.host THEN fr.b_ip ELSE fr.a_ip END AS peer, CASE WHEN fr.a_ip = w.host THEN fr.b_port ELSE fr.a_port END AS port FROM w JOIN fr ON fr.slice_id = w.slice_id AND fr.i = w.i + 1)))"""
SQL["flow_chains"] = f"""{_CHAIN} SELECT 'f' AS stream, slice_id, f_step AS step, 'FLOW' AS etype, peer || ':' || port || '/' || proto AS entity FROM w WHERE f_step IS NOT NULL
    UNION ALL SELECT 'f', slice_id, h_step, 'HOST', host FROM w WHERE h_step IS NOT NULL"""
_CASES = " ".join(f"WHEN {port} THEN '{name}'" for port, name in rules.SERVICES.items())
SQL["net_motifs"] = f"""{_CHAIN}, st AS (SELECT slice_id, f_step, was, peer, proto, CASE port {_CASES} ELSE 'SVC_OTHER' END AS svc, CASE WHEN port <= 1023 THEN 'PORT_WELLKNOWN' WHEN port <= 49151 THEN 'PORT_REGISTERED' ELSE 'PORT_DYNAMIC' END AS pb FROM w WHERE f_step IS NOT NULL),
    en AS (SELECT slice_id, f_step, CASE WHEN svc IN ('SVC_DNS', 'SVC_DHCP') THEN 'NET_' || svc[5:] ELSE 'NET_CONNECT_' || svc[5:] END AS event_type, ['HOST_' || sha1('{SALT}|' || was)[1:8], 'PEER_' || sha1('{SALT}|' || peer)[1:8], svc, 'P_' || upper(proto), pb] AS es FROM st),
    g AS (SELECT slice_id, event_type, count(*) AS n, min(f_step) AS first FROM en GROUP BY ALL), u AS (SELECT slice_id, event_type, string_agg(DISTINCT x, ',' ORDER BY x) AS entities FROM (SELECT slice_id, event_type, unnest(es) AS x FROM en) GROUP BY ALL)
    SELECT 'f' AS stream, slice_id, 'M' || row_number() OVER (PARTITION BY slice_id ORDER BY first) AS motif_id, event_type, n, entities FROM g JOIN u USING (slice_id, event_type)"""


@query
def flow_slices(spark: SparkSession, d: str) -> DataFrame:
    rows = _sliced(spark, d).groupBy("stream", "slice_id", "slice_anchor")
    return rows.agg(F.round(F.min("t_start"), 4).alias("t_start"), F.round(F.max("t_end"), 4).alias("t_end"), F.count("*").alias("flows_count"))


@query
def flow_tactics(spark: SparkSession, d: str) -> DataFrame:
    """A2 over the flow slices."""
    f = _sliced(spark, d).withColumn("anchor", F.col("slice_anchor"))
    a, b = F.col("anchor") == F.col("a_ip"), F.col("anchor") == F.col("b_ip")
    peer, port = F.when(a, F.col("b_ip")).when(b, F.col("a_ip")), F.when(a, F.col("b_port")).when(b, F.col("a_port"))
    return flows.tactics(f.select(F.concat_ws(":", "stream", F.col("slice_id").cast("string")).alias("slice"), "anchor", peer.alias("peer"), port.alias("port"), "packets", "bytes", "t_start", "t_end")).select("slice", "tactic")


@query
def flow_chains(spark: SparkSession, d: str) -> DataFrame:
    return flowslices.flow_chains(_sliced(spark, d)).select("stream", "slice_id", "step", "etype", "entity")


@query
def net_motifs(spark: SparkSession, d: str) -> DataFrame:
    found = flowslices.flow_motifs(flowslices.flow_chains(_sliced(spark, d)), SALT)
    return found.withColumn("entities", F.array_join("entities", ",")).drop("first")


@query
def w2v_labels(spark: SparkSession, d: str) -> DataFrame:
    tokens = flowslices.flow_tokens(flowslices.flow_chains(_sliced(spark, d)), SALT)
    tokens = ordered.written(tokens)  # read by the fit and after it
    model = semantics.train_vectors(tokens)
    vectors = semantics.slice_vectors(tokens, model)
    return semantics.nearest_label(vectors, semantics.seed_prototypes(model, semantics.TRAFFIC_SEEDS), tau=0.2)
