"""Emission order, behaviour slices and chains of bidirectional flows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import rules
from . import ordered

FLOW_KEY = ["t_start", "a_ip", "a_port", "b_ip", "b_port", "proto", "bucket", "session"]


def emission_order(flows: DataFrame, packets: DataFrame, idle_s: float, blocks: int | None = None) -> DataFrame:
    """flows(stream, FLOW_KEY, t_end) with `expiry`, the time of the stream's first packet over idle_s after the
    flow's end (null: none), `emitted`, the flow's place in its stream: by expiry, those without one last, then by start,
    and `block`, the range of expiry that it lies in (at most `blocks`, and one more for those without).

    Flows meet packets within ranges of time; where a range has no later packet, the next range that has any gives its first.
    """
    n = blocks or int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = packets.select("stream", F.col("timestamp").alias("at")).distinct()
    borders = ordered.cuts(times, "at", n)
    seen = ordered.in_blocks(times, "at", borders, "part")
    ends = ordered.in_blocks(flows.select("stream", (F.col("t_end") + idle_s).alias("at")).distinct(), "at", borders, "part")
    # From the latest on, so that the frame only grows: one pass over each range.
    rows = ends.select("stream", "part", "at", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("packet")).union(seen.select("stream", "part", "at", F.lit(0), F.col("at")))
    after = Window.partitionBy("stream", "part").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("stream").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("stream", "part").agg(F.min("packet").alias("first")).select("stream", "part", F.last("first", ignorenulls=True).over(later).alias("next"))
    rows = rows.withColumn("own", F.last("packet", ignorenulls=True).over(after)).filter("kind = 1").join(firsts, ["stream", "part"])
    rows = flows.withColumn("at", F.col("t_end") + idle_s).join(rows.select("stream", "at", F.coalesce("own", "next").alias("expiry")), ["stream", "at"]).drop("at")
    rows = ordered.in_blocks(rows, "expiry", borders)
    base = ordered.summed(rows, "stream", "block", F.count("*"), "_base")
    order = Window.partitionBy("stream", "block").orderBy(F.col("expiry").asc_nulls_last(), *FLOW_KEY)
    return rows.join(base, ["stream", "block"]).withColumn("emitted", F.row_number().over(order) + F.col("_base")).drop("_base")


class _Table:
    """What a block of flows does to the open slice: from the hosts (own, other) that it comes in with to those it leaves.

    Only a slice that holds the first flow's anchor h can go on into the block: as its own host (then only its other host is
    unknown) or as its other host (then only its own). One walk follows each of the two with the unknown host as a symbol; it
    forks where a flow asks whether the symbol is a certain host, and ends at the first flow that starts a slice. From there on
    nothing depends on what came in, and runs that start at one flow are walked once.
    """

    def __init__(self, flows: list[tuple], gap_s: float):
        self.flows = flows  # (t_start, anchor, a_ip, b_ip, inner)
        times = [f[0] for f in flows]
        self.wide = [False, *[b - a > gap_s for a, b in zip(times, times[1:])]]
        self.runs: dict[int, tuple] = {}

    def _peer(self, f: tuple, own: str) -> str:
        return f[2] if f[3] == own else f[3]

    def started(self, at: int) -> tuple:
        """(slices, own, other) at the block's end if flow `at` starts a slice."""
        first, chain = at, []
        while at not in self.runs:
            own, other, i = self.flows[at][1], None, at
            while True:
                if self.flows[i][4]:
                    other = self._peer(self.flows[i], own)
                i += 1
                if i == len(self.flows) or self.wide[i] or self.flows[i][1] not in (own, other):
                    break
            if i == len(self.flows):
                self.runs[at] = (1, own, other)
            else:
                chain.append(at)
                at = i
        n, own, other = self.runs[at]
        for n, p in enumerate(reversed(chain), n + 1):
            self.runs[p] = (n, own, other)
        return self.runs[first]

    def walk(self, i: int, own: str | None, other: str | None, symbol: str | None, found: dict) -> None:
        """Follow the slice from flow i on; own or other is None where it is the symbol ('own' or 'other'). found: what the symbol
        is (None: anything else) -> (slices, own, other) at the end; without a start, None stands for the symbol."""
        while i < len(self.flows):
            f = self.flows[i]
            joins = not self.wide[i] and f[1] in (own, other)
            if not joins and symbol and not self.wide[i]:
                # The slice goes on only if the symbol is this anchor.
                if f[1] not in found:
                    found[f[1]] = None
                    self.pinned(f[1], i, own, other, symbol, found)
            if not joins:
                found[None] = self.started(i)
                return
            if f[4]:
                if own is None:
                    # The other host is the end that isn't the symbol: ask for b, else it is b.
                    if f[3] not in found:
                        found[f[3]] = None
                        self.pinned(f[3], i, own, other, symbol, found)
                    other = f[3]
                else:
                    other = self._peer(f, own)
                    symbol = None if symbol == "other" else symbol
            i += 1
        found[None] = (0, own, other)

    def pinned(self, host: str, i: int, own: str | None, other: str | None, symbol: str, found: dict) -> None:
        """Follow the slice from flow i on with the symbol known."""
        own, other = (host, other) if symbol == "own" else (own, host)
        while i < len(self.flows):
            f = self.flows[i]
            if self.wide[i] or f[1] not in (own, other):
                found[host] = self.started(i)
                return
            if f[4]:
                other = self._peer(f, own)
            i += 1
        found[host] = (0, own, other)

    def rows(self) -> Iterator[tuple]:
        """(way in, symbol's host, slices, own, other): way 'new' starts a slice, 'own' and 'other' say which host h is."""
        h = self.flows[0][1]
        yield ("new", None, *self.started(0))
        for way, own, other, symbol in (("own", h, None, "other"), ("other", None, h, "own")):
            found: dict = {}
            self.walk(0, own, other, symbol, found)
            for host, (n, o, p) in found.items():
                yield (way, host, n, o, p)


TABLE = "stream string, block int, first_t double, last_t double, anchor string, way string, host string, slices long, own string, other string"
ENTRY = "stream string, block int, last_t double, own string, other string, slices long"


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list]]:
    """((stream, block), rows) of sorted rows; one block is held at a time."""
    key, held = None, []
    for frame in frames:
        for f in frame.itertuples(index=False):
            if (f.stream, f.block) != key:
                if held:
                    yield key, held
                key, held = (f.stream, f.block), []
            held.append(f)
    if held:
        yield key, held


def _tables(gap_s: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TABLE.split(", ")]
        for (stream, block), rows in _groups(frames):
            table = _Table([(f.t_start, f.anchor, f.a_ip, f.b_ip, f.inner) for f in rows], gap_s)
            out = [(stream, block, rows[0].t_start, rows[-1].t_start, rows[0].anchor, *r) for r in table.rows()]
            yield pd.DataFrame(out, columns=names, dtype=object)

    return run


def _entries(gap_s: float):
    def compose(table: pd.DataFrame) -> pd.DataFrame:
        """What each block of a stream comes in with: the tables applied one after another."""
        last = own = other = None
        slices, out = 0, []
        for block, rows in table.sort_values("block", kind="stable").groupby("block", sort=True):
            ways = {(r.way, r.host if isinstance(r.host, str) else None): (r.slices, r.own if isinstance(r.own, str) else None, r.other if isinstance(r.other, str) else None) for r in rows.itertuples()}
            head = rows.iloc[0]
            out.append((head["stream"], block, last, own, other, slices))
            wide = last is None or head["first_t"] - last > gap_s
            if not wide and head["anchor"] == own:
                n, o, p = ways.get(("own", other)) or ways["own", None]
                own, other = o, p if n or p is not None else other
            elif not wide and head["anchor"] == other:
                n, o, p = ways.get(("other", own)) or ways["other", None]
                own, other = o if n or o is not None else own, p
            else:
                n, own, other = ways["new", None]
            last, slices = head["last_t"], slices + n
        return pd.DataFrame(out, columns=[c.split()[0] for c in ENTRY.split(", ")], dtype=object)

    return compose


def _resolved(gap_s: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = own = other = None
        number = 0
        for frame in frames:
            ids, heads = [], []
            for f in frame.itertuples(index=False):
                if f.emitted == 0:  # what the block comes in with
                    text = lambda x: x if isinstance(x, str) else None
                    last, own, other, number = f.entry_t, text(f.entry_own), text(f.entry_other), f.entry_slices
                    last = None if last is None or last != last else last
                else:
                    if not (last is not None and f.t_start - last <= gap_s and f.anchor in (own, other)):
                        own, other, number = f.anchor, None, number + 1
                    if f.inner:
                        other = f.a_ip if f.b_ip == own else f.b_ip
                    last = f.t_start
                ids.append(number - 1)
                heads.append(own)
            yield frame.assign(slice_id=ids, slice_anchor=pd.Series(heads, index=frame.index, dtype=object))[frame["emitted"] != 0]

    return run


def flow_slices(flows: DataFrame, gap_s: float) -> DataFrame:
    """W2 over flows(stream, block, emitted, FLOW_KEY, ..., anchor): slice_id from 0 in each stream, and the slice's anchor.

    A flow joins the open slice if it starts at most gap_s after the flow before it and its anchor is the slice's, or is
    the other end of the last flow there between two internal hosts. Flows without anchor are left out. A carry scan: each
    block's table says what it does to the slice that comes in (_Table), the tables of a stream are applied in order, one
    small row set for each block, and then all blocks number their flows at once from what they come in with.
    """
    rows = flows.filter("anchor is not null").withColumn("inner", rules.is_internal(F.col("a_ip")) & rules.is_internal(F.col("b_ip")))
    rows = ordered.written(rows)  # read by the tables and by the numbering
    fold = rows.select("stream", "block", "emitted", "t_start", "anchor", "a_ip", "b_ip", "inner").repartition("stream", "block").sortWithinPartitions("stream", "block", "emitted")
    tables = fold.mapInPandas(_tables(gap_s), TABLE)
    entries = tables.groupBy("stream").applyInPandas(_entries(gap_s), ENTRY)
    state = {"entry_t": ("last_t", "double"), "entry_own": ("own", "string"), "entry_other": ("other", "string"), "entry_slices": ("slices", "long")}
    empty = rows.withColumns({k: F.lit(None).cast(kind) for k, (_, kind) in state.items()} | {"entry_slices": F.lit(0).cast("long")})
    none = lambda f: F.lit(None if f.dataType.simpleString() == "string" else 0).cast(f.dataType).alias(f.name)
    heads = entries.select(*[F.col(f.name) if f.name in ("stream", "block") else none(f) for f in rows.schema], *[F.col(c).alias(k) for k, (c, _) in state.items()])
    both = empty.unionByName(heads).repartition("stream", "block").sortWithinPartitions("stream", "block", "emitted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema) + ", slice_id long, slice_anchor string"
    return both.mapInPandas(_resolved(gap_s), schema).drop("inner", "block", *state)


STEP = "stream string, slice_id long, step long, etype string, entity string, src_host string, peer_ip string, peer_port int, proto string, at double, packets long, bytes long, flag string"


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key = host = None
    step, seen = 0, set()
    names = [c.split()[0] for c in STEP.split(", ")]
    for frame in frames:
        out = []
        for f in frame.itertuples(index=False):
            if (f.stream, f.slice_id) != key:
                key, host, step, seen = (f.stream, f.slice_id), f.slice_anchor, 1, {f.slice_anchor}
                out.append((*key, 1, "HOST", host, None, None, None, None, f.t_start, None, None, None))
            if host not in (f.a_ip, f.b_ip):
                continue
            peer, port = (f.b_ip, f.b_port) if f.a_ip == host else (f.a_ip, f.a_port)
            step += 1
            out.append((*key, step, "FLOW", f"{peer}:{port}/{f.proto}", host, peer, port, f.proto, f.t_start, f.packets, f.bytes, f.flag))
            if (f.a_inner if peer == f.a_ip else f.b_inner) and peer not in seen:
                host, step = peer, step + 1
                seen.add(peer)
                out.append((*key, step, "HOST", host, None, None, None, None, f.t_start, None, None, None))
        yield pd.DataFrame(out, columns=names, dtype=object)


def flow_chains(sliced: DataFrame) -> DataFrame:
    """The steps of every slice's chain, one row each: its anchor, then every flow of the host where the walk stands,
    in order of start; it moves to a flow's other end if that is internal and new. Rows are walked as they come, sorted.
    """
    rows = sliced.select("stream", "slice_id", "slice_anchor", "emitted", *FLOW_KEY, "packets", "bytes", F.col("flag") if "flag" in sliced.columns else F.lit(None).cast("string").alias("flag"))
    rows = rows.withColumns({"a_inner": rules.is_internal(F.col("a_ip")), "b_inner": rules.is_internal(F.col("b_ip"))})
    return rows.repartition("stream", "slice_id").sortWithinPartitions("stream", "slice_id", "t_start", "emitted").mapInPandas(_walk, STEP)


def flow_tokens(steps: DataFrame, salt: str, tactics: DataFrame | None = None) -> DataFrame:
    """C5 over a chain's steps: (stream, slice_id, step, tokens). Flows with a flag (their most frequent one, W6) have HAS_FLAGS
    and FLAG_ tokens; with tactics(stream, slice_id, tactic), the steps of a slice with one have HAS_TTP and TTP_ tokens."""
    steps = steps.withColumn("_ttp", F.lit(None).cast("string")) if tactics is None else steps.join(tactics.select("stream", "slice_id", F.nullif("tactic", F.lit("")).alias("_ttp")), ["stream", "slice_id"], "left")
    last = F.max("step").over(Window.partitionBy("stream", "slice_id"))
    role = F.when(F.col("step") == 1, "ROLE_SUBJ").when(F.col("step") == last, "ROLE_OBJ").otherwise("ROLE_MID")
    named = (F.when(F.col("_ttp").isNotNull(), "HAS_TTP"), F.concat(F.lit("TTP_"), "_ttp"))
    host = F.array_compact(F.array(role, F.lit("HOST"), rules.salted_token(F.col("entity"), salt, "HOST_"), *named))
    flow = F.array(
        role, F.lit("FLOW"), F.concat(F.lit("P_"), F.upper("proto")), rules.service(F.col("peer_port")), rules.port_bucket(F.col("peer_port")), F.lit("HAS_PEER"), rules.salted_token(F.col("peer_ip"), salt, "PEER_"),
        F.when(F.col("flag").isNotNull(), "HAS_FLAGS"), F.concat(F.lit("FLAG_"), "flag"),
        F.concat(F.lit("BYTES_"), rules.magnitude(F.col("bytes"), 2_000, 200_000)), F.concat(F.lit("PKT_"), rules.magnitude(F.col("packets"), 3, 30)),
        *named,
    )
    flow = F.array_compact(flow)
    return steps.select("stream", "slice_id", "step", F.when(F.col("etype") == "HOST", host).otherwise(flow).alias("tokens"))


def flow_motifs(steps: DataFrame, salt: str) -> DataFrame:
    """A3: (stream, slice_id, motif_id, event_type, n, entities) of the flow steps, numbered by first occurrence."""
    rows = steps.filter("etype = 'FLOW'")
    entity = F.array(rules.salted_token(F.col("src_host"), salt, "HOST_"), rules.salted_token(F.col("peer_ip"), salt, "PEER_"), rules.service(F.col("peer_port")), F.concat(F.lit("P_"), F.upper("proto")), rules.port_bucket(F.col("peer_port")))
    rows = rows.select("stream", "slice_id", "step", rules.network_event(F.col("peer_port")).alias("event_type"), F.explode(entity).alias("entity"))
    by = rows.groupBy("stream", "slice_id", "event_type").agg(F.count_distinct("step").alias("n"), F.array_sort(F.collect_set("entity")).alias("entities"), F.min("step").alias("first"))
    place = F.row_number().over(Window.partitionBy("stream", "slice_id").orderBy("first"))
    return by.select("stream", "slice_id", F.concat(F.lit("M"), place).alias("motif_id"), "event_type", "n", "entities", "first")
