"""Behaviour slices of ordered event streams, process sets and chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import ordered


def slice_events(events: DataFrame, gap_ns: int, blocks: int | None = None) -> DataFrame:
    """events(stream, t_ns, seq, s, o) with slice_id from 0 in each stream.

    An event joins the open slice if it is at most gap_ns after the event before it and its subject is the slice's first
    subject or that event's object, or its object is. As every event that joins without such a link has the slice's
    subject, 'the slice's subject' is the subject of the last event without a link: windows suffice, no fold.
    The windows run within blocks of time (`blocks`, by default as many as shuffle partitions); what comes before a block
    is carried in from one row for each block: the last event, the last subject without a link, and the number of slices.
    """
    n = blocks or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ordered.in_blocks(events, "t_ns", ordered.cuts(events, "t_ns", n), "_block")
    order = Window.partitionBy("stream", "_block").orderBy("t_ns", "seq")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = ["stream", "_block"]
    ends = ordered.carried(rows, *at, _e=F.max(F.struct("t_ns", "seq", "o")))
    lag = lambda c: F.coalesce(F.lag(c).over(order), F.col("_e")[c])
    rows = rows.join(ends, at).withColumns({"_t": lag("t_ns"), "_o": lag("o")})
    rows = rows.withColumn("_hard", F.col("_t").isNull() | (F.col("t_ns") - F.col("_t") > gap_ns))
    rows = rows.withColumn("_link", ~F.col("_hard") & ((F.col("s") == F.col("_o")) | (F.col("o") == F.col("_o")))).drop("_e", "_t", "_o")
    subjects = ordered.carried(rows, *at, _c=F.max(F.when(~F.col("_link"), F.struct("t_ns", "seq", "s"))))
    subject = F.coalesce(F.last(F.when(~F.col("_link"), F.col("s")), ignorenulls=True).over(before), F.col("_c.s"))
    start = F.col("_hard") | (~F.col("_link") & (F.col("s") != F.col("_s")))
    rows = rows.join(subjects, at).withColumn("_s", subject).withColumn("_start", start.cast("long"))
    base = ordered.summed(rows, *at, F.sum("_start"), "_base")
    rows = rows.join(base, at).withColumn("slice_id", F.col("_base") + F.sum("_start").over(whole) - 1)
    return rows.select(*events.columns, "slice_id")


def slice_summary(sliced: DataFrame) -> DataFrame:
    return sliced.groupBy("stream", "slice_id").agg(F.min("t_ns").alias("t_start"), F.max("t_ns").alias("t_end"), F.count("*").alias("events_count"))


def process_set(events: DataFrame, least: int = 1) -> DataFrame:
    """Ids seen as subject at least `least` times and as object."""
    subjects = events.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("id")
    return subjects.join(events.select(F.col("o").alias("id")).distinct(), "id", "left_semi")


def _walk(events: list[tuple]) -> list[int]:
    """Indexes of the events taken in time-ordered (s, o, is_process) events, from the first one's subject on."""
    by_subject: dict[str, list[int]] = {}
    for i, e in enumerate(events):
        by_subject.setdefault(e[0], []).append(i)
    here, seen, out = events[0][0], {events[0][0]}, []
    while here in by_subject:
        own = by_subject[here]
        step = next((i for i in own if events[i][2] and events[i][1] not in seen), own[0])
        out.append(step)
        _, target, process = events[step]
        if not process or target in seen:
            break
        seen.add(target)
        here = target
    return out


def chains(sliced: DataFrame, processes: DataFrame, min_len: int = 3) -> DataFrame:
    """(stream, slice_id, chain, chain_len) of the chains of at least min_len steps, one per slice.

    The first step is the first event's subject with that event's time and type and no technique; the walk goes on from
    there through objects that are processes. A step is (t_ns, entity, etype, ttp); ttp is sliced's, if it has that column.
    Only the earliest event of each (slice, subject, object) can be a step, so no more is gathered per slice.
    """
    if "ttp" not in sliced.columns:
        sliced = sliced.withColumn("ttp", F.lit(""))
    marked = sliced.join(processes.select(F.col("id").alias("o"), F.lit(True).alias("is_process")), "o", "left").withColumn("is_process", F.coalesce("is_process", F.lit(False)))
    first = marked.groupBy("stream", "slice_id", "s", "o", "is_process").agg(F.min(F.struct("t_ns", "seq", "etype", "ttp")).alias("e"))
    event = F.struct(F.col("e.t_ns").alias("t_ns"), F.col("e.seq").alias("seq"), "s", "o", "is_process", F.col("e.etype").alias("etype"), F.col("e.ttp").alias("ttp"))
    per = first.groupBy("stream", "slice_id").agg(F.array_sort(F.collect_list(event)).alias("events"))

    @F.pandas_udf("array<int>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_walk([(e["s"], e["o"], e["is_process"]) for e in events]) for events in batch])

    step = lambda e, entity, ttp: F.struct(e["t_ns"].alias("t_ns"), e[entity].alias("entity"), e["etype"].alias("etype"), ttp.alias("ttp"))
    head = F.get("events", F.lit(0))
    chain = F.concat(F.array(step(head, "s", F.lit(""))), F.transform(walk("events"), lambda i: step(F.get("events", i), "o", F.get("events", i)["ttp"])))
    rows = per.withColumn("chain", chain).select("stream", "slice_id", "chain", F.size("chain").alias("chain_len"))
    return rows.filter(F.col("chain_len") >= min_len)


def run_motifs(steps: DataFrame) -> DataFrame:
    """Runs of equal names in steps(key, pos, name, entity[, ttp]): key, run, name, n, entities in order, and (with
    ttp) the different techniques, sorted."""
    order = Window.partitionBy("key").orderBy("pos")
    new = (F.lag("name").over(order).isNull() | (F.lag("name").over(order) != F.col("name"))).cast("long")
    rows = steps.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    techniques = [F.array_sort(F.collect_set(F.when(F.col("ttp") != "", F.col("ttp")))).alias("techniques")] if "ttp" in steps.columns else []
    by = rows.groupBy("key", "run", "name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "entity"))).alias("e"), *techniques)
    return by.select("key", "run", "name", "n", F.col("e.entity").alias("entities"), *["techniques"] * len(techniques))
