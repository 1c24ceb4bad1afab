"""What samples around hubs move, and samples of targets that follow one hub only."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from hyperslice.operators import hypergraph, models
from hyperslice.plans import queries

from test_subgraphs import search


def records(spark, since):
    """Records written to shuffles by stages from `since` on, and the next stage's number."""
    store, total, number = spark.sparkContext._jsc.sc().statusStore(), 0, since
    missing = 0
    while missing < 50:
        try:
            total += store.lastStageAttempt(number).shuffleWriteRecords()
            missing = 0
        except Exception:  # noqa: BLE001 (skipped stages have no attempt)
            missing += 1
        number += 1
    return total, number - missing


def test_draws_move_once(spark):
    """3,000 targets draw 48 of a hub each; all else is 6,000 pairs. Before, draws moved to be grouped and again to be ranked."""
    inc = spark.range(3000).selectExpr("explode(array(0L, id + 1)) as node_id", "id as hid").localCheckpoint()
    _, since = records(spark, 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of any size
    try:
        assert hypergraph.subgraphs(inc, 1)["sub_edges"].count() == 3000 * 48
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved, _ = records(spark, since)
    assert 0 < moved < 2 * 3000 * 48


def test_targets_of_one_hub(spark):
    """All caps are filled by the first node; a target's own hyperedge is drawn now and then."""
    r = random.Random(3)
    inc = [(0, h) for h in range(1, 40)] + [(r.randint(1, 9), r.randint(1, 45)) for _ in range(60)]
    caps = (1, 5, 9, 5, 4, 0, 7)
    hops, most_edges, most_nodes, per_node, most_members, hub_degree, seed = caps
    df = spark.createDataFrame(inc, "node_id long, hid long")
    got = defaultdict(dict)
    for x in hypergraph.subgraphs(df, hops, most_edges, most_nodes, per_node, most_members, hub_degree, seed, keep=False)["sub_edges"].collect():
        got[x["target"]][x["epos"]] = (x["hid"], x["depth"])
    for target in {h for _, h in inc}:
        assert [got[target][i] for i in sorted(got[target])] == search(inc, target, *caps)[0]


def test_attention_moves_rows_twice(spark):
    """A sample's rows look up their hyperedge and go to their target; before, they moved once more, and again as values."""
    sample = spark.range(40000).selectExpr("id % 1000 as target", "id % 1009 as hid").localCheckpoint()
    inc = spark.range(4000).selectExpr("id % 7 as node_id", "id % 1009 as hid").distinct().localCheckpoint()
    nodes = spark.range(7).selectExpr("id as node_id", "cast(id % 4 as int) as idx", "0.5D as val")
    edges = spark.range(1009).selectExpr("id as hid", "cast(id % 4 as int) as idx", "1D as val")
    _, since = records(spark, 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = models.propagate_attention(sample, inc, nodes, edges, 4).groupBy("target", "idx").agg(F.avg("val").alias("val"))
        assert len(found.collect()) == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved, _ = records(spark, since)
    assert 0 < moved < 2.6 * 40000


def test_mean_reads_its_tables_once_written(spark):
    """The query's incidence table comes from lineitem once: its rows are dealt out by order for nodes and members, not for each use."""
    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    _, since = records(spark, 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert queries.propagate_mean(spark, d).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved, _ = records(spark, since)
    assert 0 < moved < 14.8 * lines
