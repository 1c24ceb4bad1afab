"""Structured Streaming forms of the flow and slice operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_biflows(packets: DataFrame, bucket: str = "1 second", late: str = "1 second") -> DataFrame:
    """packets(ts, ep_a, ep_b, proto, bytes) as a stream -> flows of each bucket, once the watermark passes."""
    by = packets.withWatermark("ts", late).groupBy(F.window("ts", bucket), "ep_a", "ep_b", "proto")
    return by.agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"), F.min("ts").alias("t_start"), F.max("ts").alias("t_end"))


def stream_slices(events: DataFrame, gap_ns: int) -> DataFrame:
    """events(stream, t_ns, seq, s, o) as a stream -> each with its slice_id, as in slicing.slice_events.

    State per stream: last time, last object, the slice's subject, its number. Batches must arrive in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last_o, subject, number = state.get if state.exists else (None, None, None, -1)
        rows = pd.concat(list(frames)).sort_values(["t_ns", "seq"])
        out = []
        for t, seq, s, o in rows[["t_ns", "seq", "s", "o"]].itertuples(index=False):
            if last_t is None or t - last_t > gap_ns or not (s == subject or s == last_o or o == last_o):
                number, subject = number + 1, s
            last_t, last_o = t, o
            out.append((key[0], t, seq, number))
        state.update((last_t, last_o, subject, number))
        yield pd.DataFrame(out, columns=["stream", "t_ns", "seq", "slice_id"])

    return events.groupBy("stream").applyInPandasWithState(step, "stream string, t_ns long, seq long, slice_id long", "t long, o string, s string, n long", "append", GroupStateTimeout.NoTimeout)
