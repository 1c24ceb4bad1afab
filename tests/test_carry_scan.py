"""Carry scans over blocks against one sequential pass."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hyperslice.operators import flows, flowslices, slicing
from hyperslice.plans import adapters as ad, flow_queries

SF = "/root/testdata/sf0.001"


def sequential(rows, gap):
    """(slice number, own host) of each (t_start, anchor, a_ip, b_ip, inner), and the state after them."""
    out, last, own, other, n = [], None, None, None, -1
    for t, anchor, a, b, inner in rows:
        if last is None or t - last > gap or anchor not in (own, other):
            own, other, n = anchor, None, n + 1
        if inner:
            other = a if b == own else b
        last = t
        out.append((n, own))
    return out


def random_flows(r, hosts, n, wide):
    t, rows = 0.0, []
    for _ in range(n):
        t += 9.0 if r.random() < wide else r.random()
        a, b = sorted(r.sample(hosts, 2))
        rows.append((t, r.choice((a, b)), a, b, r.random() < 0.6))
    return rows


@pytest.mark.parametrize("hosts,wide", [(2, 0.0), (3, 0.0), (3, 0.1), (5, 0.02), (12, 0.0)])
def test_tables_compose_to_the_sequential_pass(hosts, wide):
    """Random cuts of random streams: what each block comes in with, and the number of slices, by the tables alone."""
    r = random.Random(hosts * 100 + int(wide * 100))
    names = [f"10.0.0.{i}" for i in range(hosts)]
    columns = [c.split()[0] for c in flowslices.TABLE.split(", ")]
    kept = 0
    for _ in range(150):
        rows = random_flows(r, names, r.randint(1, 60), wide)
        if r.random() < 0.5:  # a stream with hosts that go on for long
            rows = [(t, a if r.random() < 0.9 else x, a, b, i) for t, x, a, b, i in rows]
        cut = sorted(r.sample(range(1, len(rows)), min(len(rows) - 1, r.randint(0, 12))))
        parts = [rows[i:j] for i, j in zip([0, *cut], [*cut, len(rows)])]
        table = pd.concat([pd.DataFrame([("x", k, p[0][0], p[-1][0], p[0][1], *row) for row in flowslices._Table(p, 3.0).rows()], columns=columns, dtype=object) for k, p in enumerate(parts)])
        entries = flowslices._entries(3.0)(table)
        want = sequential(rows, 3.0)
        at = 0
        for part, e in zip(parts, entries.itertuples()):
            last, own, other, n = e.last_t, e.own, e.other, e.slices - 1
            for (t, anchor, a, b, inner), (number, head) in zip(part, want[at : at + len(part)]):
                if last is None or t - last > 3.0 or anchor not in (own, other):
                    own, other, n = anchor, None, n + 1
                else:
                    kept += 1
                if inner:
                    other = a if b == own else b
                last = t
                assert (n, own) == (number, head)
            at += len(part)
    assert kept > 100


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_flow_slices_of_one_stream(spark, blocks):
    """One stream without a gap over blocks equals one pass; so does the order of emission."""
    packets = ad.packets(spark, SF)
    f = flows.biflows(packets)
    flat = f.select(F.col("ep_a.ip").alias("a_ip"), F.col("ep_a.port").alias("a_port"), F.col("ep_b.ip").alias("b_ip"), F.col("ep_b.port").alias("b_port"), "proto", "bucket", "session", "t_start", "t_end", "packets", "bytes", "anchor", F.lit("f").alias("stream"))
    ordered_flows = flowslices.emission_order(flat, packets.select(F.lit("f").alias("stream"), "timestamp"), 1.0, blocks)
    got = flowslices.flow_slices(ordered_flows, 1e9).orderBy("emitted").collect()
    times = sorted(r["timestamp"] for r in packets.select("timestamp").collect())
    key = lambda r: tuple(r[c] for c in flowslices.FLOW_KEY)
    for r in got:
        later = [t for t in times if t > r["t_end"] + 1.0]
        assert r["expiry"] == (later[0] if later else None)
    every = sorted(ordered_flows.collect(), key=lambda r: (r["expiry"] is None, r["expiry"] or 0, key(r)))
    assert [r["emitted"] for r in every] == list(range(1, len(every) + 1))
    inner = lambda ip: ip.startswith("10.")
    want = sequential([(r["t_start"], r["anchor"], r["a_ip"], r["b_ip"], inner(r["a_ip"]) and inner(r["b_ip"])) for r in got], 1e9)
    assert [(r["slice_id"], r["slice_anchor"]) for r in got] == want


@pytest.mark.parametrize("blocks", [1, 4, 33])
def test_slice_events_in_blocks(spark, blocks):
    """W1 over blocks equals one pass, with equal times and null objects."""
    r = random.Random(blocks)
    rows = [(f"h{r.randint(0, 2)}", r.randint(0, 400), i, f"n{r.randint(0, 3)}", f"n{r.randint(0, 3)}") for i in range(600)]
    got = {x["seq"]: x["slice_id"] for x in slicing.slice_events(spark.createDataFrame(rows, "stream string, t_ns long, seq long, s string, o string"), 5, blocks).collect()}
    state, want = {}, {}
    for stream, t, seq, s, o in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        last_t, last_o, subject, n = state.get(stream, (None, None, None, -1))
        if last_t is None or t - last_t > 5 or not (s == subject or s == last_o or o == last_o):
            n, subject = n + 1, s
        state[stream] = (t, o, subject, n)
        want[seq] = n
    assert got == want
