"""Packs, tokens with flags, fills, strata, ordered sensors, gathered features and the written hypergraph."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from hyperslice.functions import rules
from hyperslice.operators import flowslices, hypergraph, packs, scoring, splits
from hyperslice.sources import files

STEPS = "stream string, slice_id long, step long, etype string, entity string, src_host string, peer_ip string, peer_port int, proto string, at double, packets long, bytes long, flag string"


def test_flow_tokens_with_flags_and_techniques(spark):
    rows = [("f", 0, 1, "HOST", "10.0.0.1", None, None, None, None, 0.0, None, None, None), ("f", 0, 2, "FLOW", "x", "10.0.0.1", "8.8.8.8", 443, "TCP", 0.0, 5, 100, "SYN"), ("f", 1, 1, "FLOW", "x", "10.0.0.1", "8.8.8.8", 53, "UDP", 0.0, 5, 100, None)]
    steps = spark.createDataFrame(rows, STEPS)
    tactics = spark.createDataFrame([("f", 0, "TA0007:Discovery"), ("f", 1, "")], "stream string, slice_id long, tactic string")
    plain = {(r["slice_id"], r["step"]): r["tokens"] for r in flowslices.flow_tokens(steps, "s").collect()}
    told = {(r["slice_id"], r["step"]): r["tokens"] for r in flowslices.flow_tokens(steps, "s", tactics).collect()}
    token = plain[0, 2][6]
    assert plain[0, 2] == ["ROLE_OBJ", "FLOW", "P_TCP", "SVC_HTTPS", "PORT_WELLKNOWN", "HAS_PEER", token, "HAS_FLAGS", "FLAG_SYN", "BYTES_L", "PKT_M"] and token.startswith("PEER_")
    assert told[0, 2] == [*plain[0, 2], "HAS_TTP", "TTP_TA0007:Discovery"] and told[0, 1][-2:] == ["HAS_TTP", "TTP_TA0007:Discovery"]
    assert plain[1, 1] == told[1, 1] and "HAS_FLAGS" not in told[1, 1]


def test_bag_labels(spark):
    """Cosines of counts with seeds; ties go to the earlier label; slices without a seed have 0 everywhere."""
    seeds = {"a": ("x", "y"), "b": ("y", "z"), "c": ("w",)}
    r = random.Random(1)
    rows = [("s", i, w, r.randint(1, 4)) for i in range(30) for w in r.sample("wxyzuv", r.randint(1, 4))] + [("s", 99, "u", 3), ("s", 98, "y", 1)]
    got = {x["slice_id"]: x for x in packs.bag_labels(spark.createDataFrame(rows, "stream string, slice_id long, word string, n long"), seeds, 0.3).collect()}
    for i in {x[1] for x in rows}:
        own = {w: n for _, k, w, n in rows if k == i}
        norm = math.sqrt(sum(n * n for n in own.values()))
        sims = {label: sum(own.get(w, 0) for w in s) / norm / math.sqrt(len(s)) for label, s in seeds.items()}
        best = max(seeds, key=lambda label: (round(sims[label], 12), -list(seeds).index(label)))
        assert got[i]["sims"] == pytest.approx(sims) and got[i]["semantic_score"] == pytest.approx(sims[best])
        assert got[i]["semantic_label"] == (best if sims[best] >= 0.3 else "UNK")


def test_host_packs_feed_the_hypergraph(spark):
    step = lambda t, e, kind, ttp: (t, e, kind, ttp)
    chains = [("h", 0, [step(5, "p", "E1", ""), step(5, "q", "E1", "T1055"), step(6, "r", "E2", "")]), ("h", 1, [step(9, "p", "E2", ""), step(10, "s", "E2", ""), step(11, "q", "E1", "")])]
    chains = spark.createDataFrame(chains, "stream string, slice_id long, chain array<struct<t_ns: long, entity: string, etype: string, ttp: string>>")
    labels = spark.createDataFrame([("h", 0, "Execution", 0.75)], "stream string, slice_id long, semantic_label string, semantic_score double")
    found = packs.host_packs(chains, labels, b"key")
    rows = {r["slice_id"]: r for r in found.collect()}
    name = {e: spark.range(1).select(rules.keyed_token(F.lit(e), b"key").alias("x")).first()["x"] for e in "pqrs"}
    assert [(m["event_type"], m["count"], m["entities"], m["techniques"]) for m in rows[0]["motifs"]] == [("E1", 2, [name["p"], name["q"]], ["T1055"]), ("E2", 1, [name["r"]], [])]
    assert (rows[0]["ttp"], rows[0]["semantic_label"], rows[0]["t_start"], rows[1]["ttp"], rows[1]["semantic_label"]) == ("T1055", "Execution", 5, "", None)
    assert "进程注入相关行为" in rows[0]["evidence_sentence"] and rows[1]["evidence_sentence"].endswith("。")
    t = hypergraph.from_packs(found, F.lit(0), ["t_start", "slice_id"])
    edges = {r["hid"]: r for r in t["hyperedges"].collect()}
    assert edges[0]["edge_attr"] == [0.75, 3.0, 3.0] and edges[0]["techniques"] == {"T1055": 1.0} and edges[1]["event_types"] == {"E1": 1.0, "E2": 2.0}
    files_in = {(r["hid"], r["token"]) for r in t["incidence"].join(t["nodes"], "node_id").collect()}
    assert files_in == {(0, name["p"]), (0, name["q"]), (0, name["r"]), (0, "EVT:E1"), (0, "EVT:E2"), (1, name["p"]), (1, name["s"]), (1, name["q"]), (1, "EVT:E1"), (1, "EVT:E2")}


def test_flow_packs(spark):
    """One slice with two kinds of events and a tactic, one with a chain too short."""
    flow = lambda s, t: ("f", s, t, t + 1.0)
    sliced = spark.createDataFrame([flow(0, 0.0), flow(0, 2.0), flow(1, 9.0)], "stream string, slice_id long, t_start double, t_end double")
    step = lambda s, i, kind, port: ("f", s, i, kind, "e", "10.0.0.1", None if port is None else "8.8.8.8", port, "TCP", 0.0, 1, 1, None)
    steps = spark.createDataFrame([step(0, 1, "HOST", None), step(0, 2, "FLOW", 443), step(0, 3, "FLOW", 53), step(1, 1, "HOST", None)], STEPS)
    labels = spark.createDataFrame([("f", 0, "Discovery", 0.5), ("f", 1, "UNK", 0.1)], "stream string, slice_id long, semantic_label string, semantic_score double")
    tactics = spark.createDataFrame([("f", 0, "TA0007:Discovery"), ("f", 1, "TA0000:Benign")], "stream string, slice_id long, tactic string")
    (row,) = packs.flow_packs(sliced, steps, labels, tactics, "salt").collect()
    assert (row["slice_id"], row["t_start"], row["semantic_label"], row["ttp"], row["chain_len"]) == (0, 0.0, "Discovery", "TA0007:Discovery", 3)
    assert [(m["event_type"], m["count"], m["techniques"]) for m in row["motifs"]] == [("NET_CONNECT_HTTPS", 1, ["TA0007:Discovery"]), ("NET_DNS", 1, ["TA0007:Discovery"])]
    assert "3.00s" in row["evidence_sentence"] and "Discovery" in row["evidence_sentence"]


def test_fill_strata_and_sensor_order(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "id long")
    drawn = spark.createDataFrame([(0, 0), (1, 0)], "id long, draw long")
    for total in (1, 2, 4, 7, 18):
        got = [r["id"] for r in scoring.fill(rows, "id", drawn, total, 3).collect()]
        assert len(got) == max(2, total) and {0, 1} <= set(got) and max(got.count(i) for i in range(5)) <= 1 + -(-max(0, total - 2) // 5)
    df = spark.createDataFrame([("a", "hi"), ("", None), (None, "")], "l string, s string")
    assert [r[0] for r in df.select(splits.stratum_key("l", "s")).collect()] == ["a|hi", "UNK|unknown", "UNK|unknown"]
    assert [r[0] for r in df.select(splits.stratum_key("l")).collect()] == ["a", "UNK", "UNK"]
    edge = spark.createDataFrame([(1, "2.0"), (2, "1.0"), (3, "x")], "packet_id long, timestamp string")
    private = spark.createDataFrame([(1, "2.0"), (2, "0.5"), (4, None)], "packet_id long, timestamp string")
    got = [(r["timestamp"], r["sensor"], r["packet_id"]) for r in files.in_time_order(files.merge_sensors(edge, private), 3).collect()]
    assert got == [(0.5, "pvt", 2), (1.0, "edge", 2), (2.0, "edge", 1), (2.0, "pvt", 1)]


def test_gathered_features_and_written_tables(spark, tmp_path):
    inc = spark.createDataFrame([(10, 1), (11, 1), (11, 2)], "node_id long, hid long")
    t = hypergraph.subgraphs(inc, 1)
    nodes = spark.createDataFrame([(10, [1.0]), (11, [2.0])], "node_id long, vec array<double>")
    edges = spark.createDataFrame([(1, [3.0]), (2, [4.0])], "hid long, vec array<double>")
    of_nodes, of_edges = hypergraph.gather(t, nodes, edges)
    assert {(r["target"], r["npos"], r["vec"][0]) for r in of_nodes.collect()} == {(1, 0, 1.0), (1, 1, 2.0), (2, 0, 2.0)}
    assert {(r["target"], r["epos"], r["vec"][0]) for r in of_edges.collect()} == {(1, 0, 3.0), (1, 1, 4.0), (2, 0, 4.0), (2, 1, 3.0)}
    labels = spark.createDataFrame([("x", 0)], "label string, y int")
    files.write_hypergraph(nodes, edges, inc, labels, str(tmp_path / "g"))
    meta = [json.loads(line) for f in (tmp_path / "g" / "meta").glob("*.json") for line in f.read_text().splitlines()]
    assert meta == [{"num_nodes": 2, "num_hyperedges": 2, "nnz": 3, "num_labels": 1}]
    assert spark.read.parquet(str(tmp_path / "g" / "incidence")).count() == 3
