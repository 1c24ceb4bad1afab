"""Flow slices, chains, motifs and labels against sequential restatements."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hyperslice.functions import rules
from hyperslice.operators import flowslices, semantics
from hyperslice.plans import flow_queries

SF = "/root/testdata/sf0.001"


def inner(ip):
    return ip.startswith("10.")


def restated(rows, gap):
    """Slices by one pass over a stream's flows in emission order: {slice: [flows]}."""
    out, last, own, other = [], None, None, None
    for f in rows:
        if out and f["t_start"] - last <= gap and f["anchor"] in {own, other} - {None}:
            out[-1].append(f)
        else:
            out.append([f])
            own, other = f["anchor"], None
        if inner(f["a_ip"]) and inner(f["b_ip"]):
            other = f["a_ip"] if f["b_ip"] == own else f["b_ip"]
        last = f["t_start"]
    return out


def walked(part):
    here, steps = part[0]["anchor"], [("HOST", part[0]["anchor"])]
    known = {here}
    for f in sorted(part, key=lambda f: f["t_start"]):
        if here in (f["a_ip"], f["b_ip"]):
            side = "b" if f["a_ip"] == here else "a"
            peer = f[f"{side}_ip"]
            steps.append(("FLOW", f"{peer}:{f[f'{side}_port']}/{f['proto']}"))
            if inner(peer) and peer not in known:
                known.add(peer)
                here = peer
                steps.append(("HOST", peer))
    return steps


def test_flow_slices_and_chains(spark):
    sliced = flow_queries._sliced(spark, SF)
    rows = defaultdict(list)
    for r in sliced.collect():
        rows[r["stream"]].append(r.asDict())
    chains = defaultdict(list)
    for r in flow_queries.flow_chains(spark, SF).orderBy("stream", "slice_id", "step").collect():
        chains[r["stream"], r["slice_id"]].append((r["etype"], r["entity"]))
    several = 0
    for stream, own in rows.items():
        own.sort(key=lambda r: r["emitted"])
        want = restated(own, flow_queries.GAP_S)
        assert [r["slice_id"] for r in own] == [i for i, part in enumerate(want) for _ in part]
        for i, part in enumerate(want):
            several += len(part) > 1
            assert chains[stream, i] == walked(part)
    assert several > 50


def test_emission_order(spark):
    """Flows leave when the first packet later than their end and the idle time arrives; the rest at the end."""
    columns = "stream string, t_start double, t_end double, a_ip string, a_port int, b_ip string, b_port int, proto string, bucket long, session long"
    flow = lambda t, e: ("x", t, e, "10.0.0.1", 1, "10.0.0.2", 2, "TCP", int(t), 0)
    flows = spark.createDataFrame([flow(0.0, 5.0), flow(1.0, 1.5), flow(2.0, 2.0), flow(9.0, 9.0)], columns)
    packets = spark.createDataFrame([("x", t) for t in (0.0, 1.0, 1.5, 2.0, 3.0, 5.0, 9.0)], "stream string, timestamp double")
    got = {r["t_start"]: (r["expiry"], r["emitted"]) for r in flowslices.emission_order(flows, packets, 1.0).collect()}
    assert got == {1.0: (3.0, 1), 2.0: (5.0, 2), 0.0: (9.0, 3), 9.0: (None, 4)}


def test_net_motifs(spark):
    steps = flowslices.flow_chains(flow_queries._sliced(spark, SF)).filter("etype = 'FLOW'")
    want = Counter((r["stream"], r["slice_id"], r["e"]) for r in steps.select("stream", "slice_id", rules.network_event(F.col("peer_port")).alias("e")).collect())
    got = flow_queries.net_motifs(spark, SF).collect()
    assert {(r["stream"], r["slice_id"], r["event_type"]): r["n"] for r in got} == dict(want)
    assert all(r["entities"].split(",") == sorted(set(r["entities"].split(","))) for r in got)


def test_nearest_label(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, -1.0]), (4, [0.0, 0.0])], "id int, vec array<double>")
    got = {r["id"]: r["semantic_label"] for r in semantics.nearest_label(vectors, {"a": [2.0, 0.0], "b": [0.0, 1.0], "c": [0.0, 2.0]}, tau=0.1).collect()}
    assert got == {1: "a", 2: "b", 3: "UNK", 4: "UNK"}


def test_w2v_labels(spark):
    got = flow_queries.w2v_labels(spark, SF).collect()
    assert len(got) == flow_queries.flow_slices(spark, SF).count()
    assert {r["semantic_label"] for r in got} <= {*semantics.TRAFFIC_SEEDS, "UNK"}
    assert all(-1.0001 <= r["semantic_score"] <= 1.0001 for r in got)
