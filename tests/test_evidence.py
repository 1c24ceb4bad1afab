"""Evidence sentences, host tokens, attention propagation, prototypes and the weighted head."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from hyperslice.operators import evidence, models, scoring
from hyperslice.plans import adapters as ad, evidence_queries

SF = "/root/testdata/sf0.001"


def test_host_tokens_and_sentences(spark):
    rows = [("x", 0, 1, "EVENT_FORK", "aa", ""), ("x", 0, 2, "EVENT_EXECUTE", "bb", ""), ("x", 0, 3, "EVENT_EXECUTE", "cc", None), ("x", 1, 1, "EVENT_FORK", "dd", "T1105"), ("x", 1, 2, "EVENT_READ", "ee", "T1055"), ("x", 2, 1, "EVENT_READ", "ff", ""), ("x", 2, 2, "EVENT_FORK", "gg", "")]
    steps = spark.createDataFrame(rows, "stream string, slice_id long, step int, names string, entity string, ttp string")
    labels = spark.createDataFrame([("x", 0, "Execution"), ("x", 1, "nothing")], "stream string, slice_id long, semantic_label string")
    got = {r["slice_id"]: r["evidence_sentence"] for r in evidence.host_sentences(steps, labels).collect()}
    assert got[0] == "进程 aa 通过 进程执行行为，在执行阶段对进程 cc 执行了进程执行行为。"
    assert got[1] == "进程 dd 通过 进程注入相关行为，在未知阶段对进程 ee 执行了进程注入相关行为。"
    assert got[2] == "进程 ff 通过 EVENT_READ，在未知阶段对进程 gg 执行了EVENT_READ。"
    tokens = {(r["slice_id"], r["step"]): r["tokens"] for r in evidence.host_tokens(steps).collect()}
    assert tokens[0, 1] == ["EVENT_FORK", "ROLE_SUBJ"] and tokens[0, 2] == ["EVENT_EXECUTE", "ROLE_PROC"]
    assert tokens[1, 2] == ["EVENT_READ", "ROLE_OBJ", "HAS_TTP", "TTP_T1055"]


def test_flow_sentences(spark):
    slices = spark.createDataFrame([("x", 0, 1.0, 3.5, "Benign"), ("x", 1, 2.0, 2.0, "UNK")], "stream string, slice_id long, t_start double, t_end double, semantic_label string")
    motifs = spark.createDataFrame([("x", 0, "E2", ["HOST_a", "PEER_b"], 4), ("x", 0, "E1", ["PEER_b", "PEER_c"], 2)], "stream string, slice_id long, event_type string, entities array<string>, first long")
    got = {r["slice_id"]: r["evidence_sentence"] for r in evidence.flow_sentences(slices, motifs).collect()}
    assert got == {0: "该切片在 2.50s 内触发 2 类网络事件（E1、E2），涉及 2 个对端实体，语义映射为 Benign。", 1: "该切片在 0.00s 内触发 0 类网络事件（网络通信事件），涉及 0 个对端实体，语义映射为 UNK。"}


def test_propagate_attention(spark):
    sample = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "target long, hid long")
    inc = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "node_id long, hid long")
    nodes = spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0)], "node_id long, idx int, val double")
    edges = spark.createDataFrame([(1, 0, 3.0), (2, 1, 1.0)], "hid long, idx int, val double")
    got = {(r["target"], r["hid"], r["idx"]): r["val"] for r in models.propagate_attention(sample, inc, nodes, edges, 4).collect()}
    a = math.exp(3 / 2) / (math.exp(3 / 2) + math.exp(2 / 2))
    want = {(1, 1, 0): 3 + a, (1, 1, 1): 2 * a, (1, 2, 1): 1 + 2 * (1 - a), (2, 2, 1): 3.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_prototypes_and_head(spark):
    v = ad.vectors(spark, SF)
    got = models.multi_prototypes(v).collect()
    assert all(abs(sum(x * x for x in r["proto"]) - 1) < 1e-9 for r in got)
    assert len({r["label"] for r in got}) == v.select("label").distinct().count()
    few = models.multi_prototypes(v.groupBy("label").agg(F.first("id").alias("id"), F.first("vec").alias("vec"))).collect()
    assert len(few) == v.select("label").distinct().count()
    head = models.weighted_head(v)
    assert head.count() == v.count()
    assert head.filter("p < 0 or p > 1.000001").isEmpty()


def test_evidence_queries(spark):
    for name in ("flow_evidence", "host_evidence"):
        rows = evidence_queries.QUERIES[name](spark, SF).collect()
        assert rows and all(r["evidence_sentence"].endswith("。") for r in rows)


def test_lloyd_of_all_classes(spark):
    """Each class's centres equal numpy's from the same start; an empty centre stays; jobs don't grow with the classes."""
    r = np.random.default_rng(3)
    data = {c: r.normal(c % 3, 1 + c, (r.integers(1, 60), 5)) for c in range(7)}
    points = spark.createDataFrame([(c, row.tolist()) for c, x in data.items() for row in x], "label int, vec array<double>")
    starts = {c: np.vstack([x[: min(3, len(x))], np.full((1, 5), 1e6)]) for c, x in data.items()}
    start = spark.createDataFrame([(c, k, row.tolist()) for c, x in starts.items() for k, row in enumerate(x)], "label int, centre int, vec array<double>")
    got = {(x["label"], x["centre"]): x["vec"] for x in models.lloyd(points, start, 4).collect()}
    for c, x in data.items():
        centres = starts[c].copy()
        for _ in range(4):
            near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.stack([x[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
        assert np.allclose([got[c, k] for k in range(len(centres))], centres)


def test_quota_sample_ranks_few(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "a" if i % 5 else "b") for i in range(4000)], "id long, label string")
    got = {(x["label"], x["id"]) for x in scoring.quota_sample(rows, "label", "id", 30, 9).collect()}
    want = set()
    for label in (None, "a", "b"):
        own = [i for i in range(4000) if (None if i % 7 == 0 else "a" if i % 5 else "b") == label]
        want |= {(label, i) for i in sorted(own, key=lambda i: hashlib.md5(f"9|{i}".encode()).hexdigest())[:30]}
    assert got == want
