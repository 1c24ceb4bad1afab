"""Streaming slices: out-of-order rows over many batches give the batch operators' slices; late rows are counted; state goes."""

import random

from pyspark.sql import functions as F

from hyperslice.functions import rules
from hyperslice.operators import flowslices, slicing
from hyperslice.streaming import slices, streams

EVENTS = "stream string, t_ns long, seq long, s string, o string"
END = 10_000_000_000_000_000  # beyond all rows: moves the watermark


def run(spark, tmp_path, batches, schema, make, name):
    """Feed one file after another and give back all output rows and the last progress."""
    slices.configure(spark)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    progress = q.lastProgress
    q.stop()
    return [r.asDict() for r in spark.table(name).collect()], progress


def numbered(rows, key):
    """Slices as sets of rows: the runs' numbers only tell them apart."""
    found = {}
    for r in rows:
        found.setdefault(key(r), set()).add(r["seq"])
    return sorted(map(sorted, found.values()))


def test_event_slices_of_shuffled_batches(spark, tmp_path):
    r = random.Random(4)
    second = 10**9
    rows = [(f"h{r.randint(0, 1)}", r.randint(1, 300) * second, i, f"n{r.randint(0, 3)}", f"n{r.randint(0, 3)}") for i in range(160)]
    rows += [(f"h{r.randint(0, 1)}", r.randint(900, 1000) * second, i, f"n{r.randint(0, 3)}", f"n{r.randint(0, 3)}") for i in range(160, 200)]
    arrival = sorted(rows, key=lambda x: x[1] + r.randint(0, 20) * second)  # at most 20 s out of order
    batches = [arrival[i : i + 50] for i in range(0, len(arrival), 50)]
    lost = ("h0", second // 2, 999, "n0", "n1")
    batches[-1] = [*batches[-1], lost, ("h9", second, 998, "a", "b")]
    batches.append([("end", END // 1000 * 1000, 1000, "x", "x")])
    got, progress = run(spark, tmp_path, batches, EVENTS, lambda s: slices.stream_event_slices(s, 5 * second, "40 seconds", 60.0), "event_slices")
    want = slicing.slice_events(spark.createDataFrame(rows, EVENTS), 5 * second).collect()
    told = [x for x in got if not x["late"]]
    assert numbered(told, lambda x: (x["stream"], x["run"], x["slice_id"])) == numbered(want, lambda x: (x["stream"], x["slice_id"]))
    assert {x["seq"] for x in got if x["late"]} == {998, 999} and all(x["slice_id"] is None for x in got if x["late"])
    assert len({x["run"] for x in told if x["stream"] == "h0"}) == 2
    counts = {x["stream"]: (x["in_time"], x["late"]) for x in slices.late_counts(spark.table("event_slices")).collect()}
    assert sum(n for n, _ in counts.values()) == 200 and sum(n for _, n in counts.values()) == 2


def test_flow_slices_from_packets(spark, tmp_path):
    """X1 into X3: packets as a stream to flows of windows, and those to slices, equal to the batch operator on the same flows."""
    r = random.Random(6)
    hosts = [f"10.0.0.{i}" for i in range(4)] + ["8.8.8.8"]
    base = 1_700_000_000
    packets = []
    for i in range(300):
        a, b = sorted(r.sample(hosts, 2))
        packets.append((base + r.randint(0, 60) + (200 if i > 200 else 0), a, b, "TCP", r.randint(1, 99)))
    arrival = sorted(packets, key=lambda p: p[0] + r.randint(0, 8))
    batches = [arrival[i : i + 75] for i in range(0, 300, 75)] + [[(base + 10_000, "10.0.0.1", "10.0.0.2", "TCP", 1)], [(base + 20_000, "10.0.0.1", "10.0.0.2", "TCP", 1)], [(base + 30_000, "10.0.0.1", "10.0.0.2", "TCP", 1)]]
    schema = "at long, ep_a string, ep_b string, proto string, bytes long"

    def flows_of(found):
        a, b = F.col("ep_a"), F.col("ep_b")
        ia, ib = rules.is_internal(a), rules.is_internal(b)
        micros = lambda c: F.unix_micros(c)
        return found.select(
            F.lit("f").alias("stream"), micros(F.col("window.end")).alias("emitted_us"), micros(F.col("t_start")).alias("start_us"), a.alias("a_ip"), F.lit(0).alias("a_port"), b.alias("b_ip"), F.lit(0).alias("b_port"),
            "proto", F.when(ia, a).when(ib, b).alias("anchor"), (ia & ib).alias("inner"), "packets",
        )

    make = lambda s: slices.stream_flow_slices(flows_of(streams.stream_biflows(s.withColumn("ts", F.timestamp_seconds("at")), late="12 seconds")), 3.0, None, 60.0)
    got, _ = run(spark, tmp_path, batches, schema, make, "flow_slices")
    key = ["start_us", "a_ip", "b_ip"]
    told = {tuple(x[c] for c in key): (x["run"], x["slice_id"]) for x in got if x["start_us"] < (base + 5000) * 10**6}
    batch = spark.createDataFrame(packets, schema).withColumn("ts", F.timestamp_seconds("at")).groupBy(F.window("ts", "1 second"), "ep_a", "ep_b", "proto").agg(F.count("*").alias("packets"), F.min("ts").alias("t_start"))
    rows = flows_of(batch).withColumns({"t_start": F.col("start_us") / 1e6, "bucket": F.col("emitted_us"), "session": F.lit(0).cast("long"), "block": F.lit(0)})
    from pyspark.sql import Window

    rows = rows.withColumn("emitted", F.row_number().over(Window.orderBy("emitted_us", "start_us", "a_ip", "b_ip", "proto")).cast("long"))
    want = {tuple(x[c] for c in key): x["slice_id"] for x in flowslices.flow_slices(rows, 3.0).collect()}
    assert told.keys() == want.keys() and not any(x["late"] for x in got)
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups(told) == groups(want) and len(set(want.values())) > 5
