"""Slices of event and flow streams in event time: rows wait for the watermark, are folded in order, and leave no state behind.

State of a stream: the rows ahead of the watermark, and the open slice (last time, its hosts or subject and object, its number).
A timer at the earliest waiting row hands over all rows the watermark has passed, sorted; so rows may come in any order within
`late`. Rows behind the watermark come out at once, marked late, with no slice. After `idle` without rows the state goes; what
comes later is a new run of the stream. As idle is longer than the gap, a run's first row starts a slice anyway.
The state store must be RocksDB's, which these operators need: configure(spark).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    """The state store of the session's streaming queries."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def event_joins(gap_ns: int) -> Callable:
    """W1's fold: (time, row, (last time, subject, last object) or None) -> (joins, subject, object)."""

    def step(t: int, row: tuple, state: tuple | None) -> tuple:
        s, o = row
        joins = state is not None and t - state[0] <= gap_ns and (s == state[1] or (state[2] is not None and state[2] in (s, o)))
        return joins, state[1] if joins else s, o

    return step


def flow_joins(gap_us: int) -> Callable:
    """W2's fold: (start, (anchor, a_ip, b_ip, inner), (last start, own host, other host) or None) -> (joins, own, other)."""

    def step(t: int, row: tuple, state: tuple | None) -> tuple:
        anchor, a, b, inner = row
        joins = state is not None and t - state[0] <= gap_us and anchor in (state[1], state[2])
        own, other = (state[1], state[2]) if joins else (anchor, None)
        return joins, own, (a if b == own else b) if inner else other

    return step


class Slicer(StatefulProcessor):
    """Rows of one stream, buffered up to the watermark and folded in the order of (at_us, order)."""

    def __init__(self, step: Callable, order: list[str], fields: list[str], time: str, idle_ms: int, rows: StructType, out: list[str], chained: bool):
        self.step, self.order, self.fields, self.time, self.idle, self.schema, self.out, self.chained = step, order, fields, time, idle_ms, rows, out, chained

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.open = handle.getValueState("open", "t LONG, a STRING, b STRING, run LONG, n LONG, at LONG")

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.out, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        if self.chained:  # what an operator before this one hands over at a watermark isn't behind it; what was folded is
            mark = self.open.get()[5] - 1 if self.open.exists() else -1
        late, kept = [], []
        for frame in rows:
            for row in frame[self.schema.names].astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                at = int(row[0])
                (late if at <= mark else kept).append((at, *row[1:]))
        if kept:
            self.waiting.appendList(kept)
            self.handle.registerTimer(-(-min(r[0] for r in kept) // 1000))
        yield from self._frame([(key[0], *row, None, None, True) for row in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        names = self.schema.names
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        by = [names.index(c) for c in self.order]
        due = sorted((r for r in rows if r[0] <= mark), key=lambda r: [(r[i] is not None, r[i]) for i in (0, *by)])
        rest = [r for r in rows if r[0] > mark]
        state = tuple(self.open.get()) if self.open.exists() else None
        fields, time = [names.index(c) for c in self.fields], names.index(self.time)
        out = []
        for row in due:
            t = int(row[time])
            if state is not None and row[0] - state[5] > self.idle * 1000:
                state = None
            joins, a, b = self.step(t, tuple(row[i] for i in fields), None if state is None else state[:3])
            run, n = (row[0], 0) if state is None else (state[3], state[4] + (not joins))
            state = (t, a, b, run, n, row[0])
            out.append((key[0], *row, run, n, False))
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if state is not None and state[5] + self.idle * 1000 < mark and not rest:
            self.open.clear()
        elif state is not None:
            if due:
                self.open.update(state)
            self.handle.registerTimer(max(mark // 1000 + 1, state[5] // 1000 + self.idle + 1))
        if rest:
            self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))
        yield from self._frame(out)


def _slices(rows: DataFrame, at_us, step: Callable, order: list[str], fields: list[str], time: str, late: str | None, idle_s: float) -> DataFrame:
    columns = [c for c in rows.columns if c != "stream"]
    marked = rows.withColumn("_event_time", F.timestamp_micros(at_us))
    marked = marked if late is None else marked.withWatermark("_event_time", late)
    # The operator itself tells late rows; a column with the watermark's mark would be filtered before it.
    own = marked.select("stream", F.unix_micros("_event_time").alias("at_us", metadata={}), *columns)
    schema = StructType([f for f in own.schema.fields if f.name != "stream"])
    out = StructType([own.schema["stream"], *schema.fields]).add("run", "long").add("slice_id", "long").add("late", "boolean")
    processor = Slicer(step, order, fields, time, int(idle_s * 1000), schema, out.names, late is None)
    return own.groupBy("stream").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def stream_event_slices(events: DataFrame, gap_ns: int, late: str = "10 seconds", idle_s: float = 3600.0) -> DataFrame:
    """events(stream, t_ns, seq, s, o, ...) as a stream -> each with at_us, run (time of the run's first row, in
    microseconds), slice_id from 0 in each run, and late. Within a run slices are slicing.slice_events'.

    idle_s must be longer than the gap.
    """
    if idle_s * 1e9 <= gap_ns:
        raise ValueError("idle_s must be longer than the gap")
    return _slices(events, F.floor(F.col("t_ns") / 1000).cast("long"), event_joins(gap_ns), ["t_ns", "seq"], ["s", "o"], "t_ns", late, idle_s)


def stream_flow_slices(flows: DataFrame, gap_s: float, late: str | None = "10 seconds", idle_s: float = 3600.0) -> DataFrame:
    """flows(stream, emitted_us, start_us, a_ip, a_port, b_ip, b_port, proto, anchor, inner, ...) as a stream -> each with
    run, slice_id and late. Flows go by emitted_us (the time at which they were complete, as stream_biflows' window ends),
    then start and endpoints; within a run slices are flowslices.flow_slices' of that order. Flows without anchor are left out.

    late=None takes the watermark that flows have already: behind stream_biflows, its own.
    """
    if idle_s <= gap_s:
        raise ValueError("idle_s must be longer than the gap")
    order = ["start_us", "a_ip", "a_port", "b_ip", "b_port", "proto"]
    return _slices(flows.filter("anchor is not null"), F.col("emitted_us"), flow_joins(int(gap_s * 1e6)), order, ["anchor", "a_ip", "b_ip", "inner"], "start_us", late, idle_s)


def late_counts(sliced: DataFrame) -> DataFrame:
    """Rows of a finished run's result by stream: told in time and late."""
    return sliced.groupBy("stream").agg(F.count_if(~F.col("late")).alias("in_time"), F.count_if("late").alias("late"))
