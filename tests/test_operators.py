"""Operators against sequential restatements and small golden inputs."""

import hashlib
import hmac
import math
import random

import pytest
from pyspark.sql import functions as F

from hyperslice import catalog
from hyperslice.functions import rules
from hyperslice.operators import flows, hypergraph, metrics, normal, scoring, slicing, splits
from hyperslice.sources import files
from hyperslice.streaming import streams

SF = "/root/testdata/sf0.001"


def random_events(n, seed):
    r, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice([1, 2, 12])
        out.append((f"h{i % 3}", t, i, f"n{r.randint(0, 3)}", f"n{r.randint(0, 3)}", f"E{r.randint(0, 2)}"))
    return out


def sequential(rows, gap):
    state, out = {}, {}
    for stream, t, seq, s, o, *_ in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        last_t, last_o, subject, n = state.get(stream, (None, None, None, -1))
        if last_t is None or t - last_t > gap or not (s == subject or s == last_o or o == last_o):
            n, subject = n + 1, s
        state[stream] = (t, o, subject, n)
        out[seq] = n
    return out


def test_slices_equal_a_sequential_fold(spark):
    rows = random_events(2000, 1)
    df = spark.createDataFrame(rows, "stream string, t_ns long, seq long, s string, o string, etype string")
    got = {r["seq"]: r["slice_id"] for r in slicing.slice_events(df, 10).collect()}
    assert got == sequential(rows, 10)


def test_stream_slices_equal_batch(spark, tmp_path):
    rows = random_events(300, 2)
    schema = "stream string, t_ns long, seq long, s string, o string, etype string"
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streams.stream_slices(stream, 10).writeStream.format("memory").queryName("slices").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["seq"]: r["slice_id"] for r in spark.table("slices").collect()}
    assert got == sequential(rows, 10)


def test_stream_biflows_close_with_the_watermark(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", "a", "b", "TCP", 10) for s in (1, 1, 2, 30)]
    df = spark.createDataFrame(rows, "ts string, ep_a string, ep_b string, proto string, bytes long").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.stream_biflows(stream).writeStream.format("memory").queryName("flows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["packets"] for r in spark.table("flows").collect()) == [1, 2]


def test_chain_walk():
    events = [("a", "f", False), ("a", "b", True), ("b", "a", True), ("b", "c", True), ("c", "g", False)]
    assert slicing._walk(events) == [1, 3, 4]


def test_chain_starts_with_the_first_subject(spark):
    """a>b, b>a is a, b, a; the first step has no technique, the others their event's."""
    rows = [("x", 0, 1, 1, "a", "b", "E1", "T1"), ("x", 0, 2, 2, "b", "a", "E2", "T2")]
    sliced = spark.createDataFrame(rows, "stream string, slice_id long, t_ns long, seq long, s string, o string, etype string, ttp string")
    found = slicing.chains(sliced, slicing.process_set(sliced)).first()
    assert [tuple(x) for x in found["chain"]] == [(1, "a", "E1", ""), (1, "b", "E1", "T1"), (2, "a", "E2", "T2")] and found["chain_len"] == 3
    assert slicing.chains(sliced.filter("seq = 1"), slicing.process_set(sliced)).count() == 0


def test_name_and_event_rules(spark):
    want = {"/usr/firefox": "T1189", "/x/sysinfo": "T1082", "C:\\x\\mimikatz.exe": "T1003", "/x/ping": "T1016", "/cmd/other": "", "/x/PowerShell.exe": "T1059.001", "/x/filefilter-elevate": "T1068", None: ""}
    got = spark.createDataFrame([(k,) for k in want], "p string").select("p", rules.technique(F.col("p")).alias("t")).collect()
    assert {r["p"]: r["t"] for r in got} == want
    raw = [("2019-09-23T15:47:42.941-04:00", "a", "b", "start", "process", "h", ("C:\\x", None, "reg add HKLM")), ("bad", "a", "b", "x", "y", "h", None), ("2019-09-23T15:47:42Z", "", "b", "x", "y", "h", None), ("2019-09-23T15:47:42Z", "a", "b", "x", "y", None, None)]
    events = normal.host_events(spark.createDataFrame(raw, files.HOST_EVENT.replace(": ", " ").replace("STRUCT<image_path STRING, module_path STRING, command_line STRING>", "STRUCT<image_path: STRING, module_path: STRING, command_line: STRING>")))
    assert [(r["t_ns"], r["etype"], r["host"], r["ttp"]) for r in events.collect()] == [(1569268062941000000, "EVENT_START_PROCESS", "h", "T1112"), (1569253662000000000, "EVENT_X_Y", "", "")]
    prov = spark.createDataFrame([(5, "s", "o", "/x/cmd.exe", ["E", "F"]), (5, "s", None, "", ["E"]), (5, "s", "o", None, [])], files.PROVENANCE)
    assert [tuple(r) for r in normal.provenance_events(prov).collect()] == [(5, "s", "o", "E", "T1059.003")]


def test_services_and_network_events(spark):
    want = {53: ("SVC_DNS", "NET_DNS"), 67: ("SVC_DHCP", "NET_DHCP"), 8443: ("SVC_HTTPS", "NET_CONNECT_HTTPS"), 25: ("SVC_OTHER", "NET_CONNECT_OTHER"), 88: ("SVC_KRB", "NET_CONNECT_KRB"), None: ("SVC_OTHER", "NET_CONNECT_OTHER")}
    got = spark.createDataFrame([(k,) for k in want], "p int").select("p", rules.service(F.col("p")).alias("s"), rules.network_event(F.col("p")).alias("e")).collect()
    assert {r["p"]: (r["s"], r["e"]) for r in got} == want


def test_tactics(spark):
    flow = lambda s, peer, port, packets, n, t: (s, "10.0.0.1", peer, port, packets, n, t, t + 1.0)
    rows = [flow("scan", f"8.8.8.{i}", 1000, 1, 10, 0.1 * i) for i in range(20)] + [flow("slow", f"8.8.8.{i}", 1000, 1, 10, 2.0 * i) for i in range(20)]
    rows += [flow("lateral", "10.0.0.2", 22, 1, 10, 0.0), flow("lateral", "10.0.0.3", 445, 1, 10, 0.0), flow("out", "8.8.8.8", 999, 1, 2_000_000, 0.0)]
    rows += [flow("c2", "8.8.8.8", 443, 5, 10, t) for t in (0.0, 9.5)] + [("skip", "10.0.0.1", None, None, 99, 9_000_000, 0.0, 50.0)]
    rows = spark.createDataFrame(rows, "slice string, anchor string, peer string, port int, packets long, bytes long, t_start double, t_end double")
    got = {r["slice"]: r["tactic"] for r in flows.tactics(rows).collect()}
    assert got == {"scan": "TA0007:Discovery", "slow": "TA0000:Benign", "lateral": "TA0008:LateralMovement", "out": "TA0010:Exfiltration", "c2": "TA0011:CommandAndControl", "skip": "TA0000:Benign"}


def test_kept_technique_and_ids(spark):
    df = spark.sql("SELECT array(named_struct('e', 1, 'ttp', ''), named_struct('e', 2, 'ttp', 'T1')) AS chain")
    assert df.select(rules.kept_technique(F.col("chain"))).first()[0] == "T1"
    assert [x["ttp"] for x in df.select(rules.backfill_technique(F.col("chain"), F.lit("T9"))).first()[0]] == ["T9", "T9"]
    packs = spark.createDataFrame([("g", "monday", 1), (None, "monday", 2), (None, None, None)], "global_id string, day string, slice_id int")
    assert [r[0] for r in packs.select(rules.stable_id(packs.columns)).collect()] == ["g", "monday|2", "{}"]


def test_keyed_token_is_hmac(spark):
    row = spark.createDataFrame([("x",), ("",), (None,)], "v string").select(rules.keyed_token(F.col("v"), b"key").alias("t")).collect()
    assert [r["t"] for r in row] == [hmac.new(b"key", b"x", hashlib.sha256).hexdigest()[:8], "0" * 8, "0" * 8]


def test_internal_addresses(spark):
    ips = {"10.1.2.3": True, "8.8.8.8": False, "172.31.0.1": True, "172.32.0.1": False, "256.1.1.1": False, "x": False, "169.254.9.9": True, "::1": True, "fd00::1": True, "2a00::1": False, "010.1.1.1": False}
    got = spark.createDataFrame([(k,) for k in ips], "ip string").select("ip", rules.is_internal(F.col("ip")).alias("v")).collect()
    assert {r["ip"]: r["v"] for r in got} == ips


def test_biflows_split_at_gaps(spark):
    rows = [(i, t, "10.0.0.1", "8.8.8.8", 1, 53, "udp", 5) for i, t in enumerate((0.0, 0.2, 0.9, 1.1))]
    df = spark.createDataFrame(rows, "packet_id long, timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_len int")
    got = flows.biflows(df, 1.0, 0.5).orderBy("t_start").collect()
    assert [(r["packets"], r["anchor"]) for r in got] == [(2, "10.0.0.1"), (1, "10.0.0.1"), (1, "10.0.0.1")]


def test_splits(spark):
    df = spark.range(1000).withColumn("lang", F.when(F.col("id") % 10 == 0, "x").when(F.col("id") < 2, None).otherwise("y"))
    n = {(r["stratum"], r["split"]): r["count"] for r in splits.quota_split(df, "lang", "id", F.floor(F.col("id") / 64), ["id"]).groupBy("stratum", "split").count().collect()}
    t = {r["stratum"]: r for r in splits.quota_targets(df, "lang").collect()}
    for s, r in t.items():
        assert [n.get((s, k), 0) for k in ("train", "val", "test")] == [r["n_train"], r["n_val"], r["n_test"]]
    for small in (1, 2, 3, 7, 400):
        rows = splits.quota_split(spark.range(small).withColumn("lang", F.lit("x")), "lang", "id", F.floor(F.col("id") / 16), ["id"]).orderBy("id").collect()
        quota = splits.quota_targets(spark.range(small).withColumn("lang", F.lit("x")), "lang").first()
        room = {k: quota[f"n_{k}"] for k in splits.NAMES}
        for r in rows:  # one after another
            order = ("train", "val", "test") if r["u"] < 1 / 3 else ("val", "train", "test") if r["u"] < 2 / 3 else ("test", "train", "val")
            want = next(k for k in order if room[k])
            room[want] -= 1
            assert r["split"] == want
    got = [r["split"] for r in splits.time_split(df, F.floor(F.col("id") / 100), ["id"]).orderBy("id").collect()]
    assert got == ["train"] * 700 + ["val"] * 100 + ["test"] * 200


def test_node_ids_are_dense_and_in_order(spark):
    rows = [(5, "b", "entity"), (5, "EVT:x", "event"), (2, "c", "entity"), (2, "EVT:x", "event"), (9000, "a", "entity"), (9000, "c", "entity")]
    got = hypergraph.nodes(spark.createDataFrame(rows, "hid long, token string, type string")).orderBy("node_id").collect()
    assert [(r["node_id"], r["token"], r["type"]) for r in got] == [(0, "c", "entity"), (1, "EVT:x", "event"), (2, "b", "entity"), (3, "a", "entity")]


def test_metrics(spark):
    counts = spark.createDataFrame([(0, 0, 8), (0, 1, 2), (1, 1, 5), (1, 0, 5)], "y int, pred int, n long")
    m = metrics.macro_metrics(counts).first()
    assert m["accuracy"] == pytest.approx(13 / 20) and m["recall"] == pytest.approx((0.8 + 0.5) / 2)
    s = spark.createDataFrame([(1, 0.9, 1), (1, 0.8, 0), (1, 0.8, 1), (1, 0.1, 0)], "label int, score double, hit int")
    assert metrics.roc_auc(s).first()["auc"] == pytest.approx(3.5 / 4)
    assert metrics.average_precision(s).first()["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_prototype_scores_sum_to_one(spark):
    v = spark.createDataFrame([(i, i % 2, [float(i % 2), 1.0, 0.0]) for i in range(6)], "id long, label int, vec array<double>")
    got = scoring.prototype_scores(v, scoring.prototypes(v)).groupBy("id").agg(F.sum("p").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in got)


def test_readers(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"packet_id": 1, "timestamp": 1.5},\n\nnot json\n{"packet_id": 2}\n')
    assert sorted(r["packet_id"] for r in files.read_json_lines(spark, str(tmp_path / "x.json"), files.PACKET).filter("packet_id is not null").collect()) == [1, 2]
    (tmp_path / "y.json").write_text('[{"subject": "a"}, {"subject": "b"}]')
    assert files.read_json_array(spark, str(tmp_path / "y.json"), files.PROVENANCE).count() == 2
    packs = spark.createDataFrame([("/in/Friday-packs.jsonl", 3), ("/in/other.jsonl", None)], "source_file string, slice_id int")
    assert [r["global_id"].split(":")[:2] for r in files.merge_days(packs).orderBy("day_idx").collect()] == [["friday", "3"], ["unknown", "NA"]]
    rows, counts = files.read_json_counted(spark, str(tmp_path / "x.json"), files.PACKET)
    assert sorted(r["packet_id"] for r in rows.collect()) == [1, 2] and [(r["good"], r["bad"]) for r in counts.collect()] == [(2, 1)]
    matrix = files.confusion_matrix(spark.createDataFrame([("a", "b", 2)], "y string, pred string, n long"), ["a", "b"])
    assert [tuple(r) for r in matrix.collect()] == [("a", 0, 2), ("b", 0, 0)]


@pytest.mark.parametrize("name", sorted(set(catalog.queries())))
def test_query_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.limit(5).count() > 0 and len(set(df.columns)) == len(df.columns)


def test_quota_allocation_and_draws(spark):
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "label string, w double")
    alloc = lambda total, floors=None: {r["label"]: r["quota"] for r in scoring.quota_alloc(weights, "w", total, floors).collect()}
    assert alloc(10) == {"a": 5, "b": 3, "c": 2} and alloc(11) == {"a": 6, "b": 3, "c": 2}
    assert alloc(10, {"c": 4}) == {"a": 3, "b": 3, "c": 4} and sum(alloc(7, {"c": 3}).values()) == 7
    rows = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(5)], "id long, label string")
    quotas = spark.createDataFrame([("a", 5), ("b", 2)], "label string, quota long")
    got = scoring.draw(rows, "label", "id", quotas, 7).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).collect()
    assert {r["label"]: (r["n"], r["ids"]) for r in got} == {"a": (5, 2), "b": (2, 2)}


def test_prototype_variants(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0])], "id long, label int, vec array<double>")
    protos = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 0.0), (0, 1, 0, 0.0), (0, 1, 1, 1.0), (1, 0, 0, 0.0), (1, 0, 1, 1.0)], "label int, centre int, pos int, val double")
    logit = lambda how: {r["label"]: r["logit"] for r in scoring.prototype_scores(v, protos, 1.0, how).collect()}
    assert logit("max") == {0: 1.0, 1: 0.0} and logit("logsumexp")[0] == pytest.approx(1 + math.log(1 + math.exp(-1)))
    moved = scoring.moved_prototypes(spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0)], "label int, pos int, val double"), spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (1, 0, 1.0)], "label int, pos int, val double"), 0.5)
    assert {(r["label"], r["pos"]): round(r["val"], 4) for r in moved.collect()} == {(0, 0): 0.7071, (0, 1): 0.7071, (1, 0): 1.0}
    log = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, macro_f1 double")
    assert scoring.best_epoch(log).first()["epoch"] == 2


def test_neighbourhoods_and_samples(spark):
    """Chain 1-2-3 by nodes 10 and 20, hub 99 in all."""
    inc = spark.createDataFrame([(10, 1), (10, 2), (20, 2), (20, 3), (99, 1), (99, 2), (99, 3), (99, 4)], "node_id long, hid long")
    found = {(r["target"], r["hid"]): r["depth"] for r in hypergraph.neighbourhood(inc, 2, 3).collect()}
    assert found == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 2): 0, (2, 1): 1, (2, 3): 1, (3, 3): 0, (3, 2): 1, (3, 1): 2, (4, 4): 0}
    assert all(r["n"] <= 2 for r in hypergraph.neighbourhood(inc, 2, 0, 2).groupBy("target").agg(F.count("*").alias("n")).collect())
