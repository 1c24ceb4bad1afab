"""Near copies by shingle overlap: a segmented SimHash, pigeonring filtering, and a check of the shingle sets.

The even-weighted 64-bit SimHash of simhash.py can't find texts at similarity 0.8 whose changes are scattered: they differ
in 5 to 14 bits, and no key of a few equal bits would be rare. Here each of SEGMENTS segments is a 16-bit SimHash with
weights of its own: shingle x weighs u(x) ** -4, where u is the segment's hash of x, from 0 to 1, and the 32 heaviest
shingles count. Few shingles decide a segment, so two texts agree in one about as often as their shingle sets overlap.

Texts are candidates if at most BUDGET of the SEGMENTS segments on the ring differ. Then some segment starts a chain
whose first l segments hold at most floor(l * BUDGET / SEGMENTS) differing ones, for every l (pigeonring): none of the
first two, at most one of the first four. So the first two and the third or the fourth agree, which makes the index key;
pairs that meet at a key must pass the whole chain and are then compared by their whole sets of shingles.

Where over `pair_limit` texts meet at a key, they are compared with hubs among them (groups.py). All other pairs of
different components are met through their differences from the first hub: if x and y hold and D(x), D(y) are their
shingles that differ from the hub's, |D(x) ^ D(y)| = |x ^ y| is at most (1 - least) / (1 + least) * (|x| + |y|). If D(x)
and D(y) were disjoint, both would be near copies of the hub; else they share one of their first tokens (prefix filter,
rare tokens first). That loses no pair that meets at a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import drop, materialize, settled
from .components import connected_components
from .groups import connect
from .hashing import _mix, hashed_words, in_parts

SEGMENTS, BUDGET, HEAVIEST = 24, 11, 32
#: The smallest shingle hashes of a text, by which pairs are filtered before their whole sets are compared. An estimate
#: from so many has a standard deviation of about 0.018 at 0.8; pairs go whose estimate is more than MARGIN below.
SKETCH, MARGIN = 512, 0.1
_SEEDS = np.random.default_rng(20240301).integers(0, 1 << 64, SEGMENTS + 1, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, shingle: int) -> np.ndarray:
    """Different hashes of the runs of `shingle` words (fewer words: the whole sequence), sorted."""
    k = min(shingle, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * _STEP + words[i : i + n]
    return np.unique(_mix(total))


def segments(found: np.ndarray) -> np.ndarray:
    """The SEGMENTS 16-bit segments of a set of shingle hashes; an empty set's are 0."""
    if not len(found):
        return np.zeros(SEGMENTS, np.uint16)
    best = np.zeros((SEGMENTS, 0), np.uint64)
    for at in range(0, len(found), 1 << 13):
        best = np.concatenate([best, _mix(found[None, at : at + (1 << 13)] ^ _SEEDS[:SEGMENTS, None])], axis=1)
        if best.shape[1] > HEAVIEST:
            best = np.partition(best, HEAVIEST, axis=1)[:, :HEAVIEST]
    best = np.sort(best, axis=1)
    weight = ((best >> np.uint64(40)).astype(np.float64) + 1) ** -4
    bits = np.unpackbits(best.astype("<u2").view(np.uint8).reshape(SEGMENTS, -1, 2), axis=2, bitorder="little")
    one = 2 * np.einsum("sn,snb->sb", weight, bits) > weight.sum(axis=1)[:, None]
    return np.packbits(one, axis=1, bitorder="little").view("<u2")[:, 0]


def sketch(found: np.ndarray) -> np.ndarray:
    """The SKETCH smallest 32-bit hashes of the set, sorted."""
    return np.unique((_mix(found ^ _SEEDS[-1]) >> np.uint64(32)).astype("<u4"))[:SKETCH]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the Jaccard similarity of two sets from their sketches."""
    low = np.union1d(a, b)
    if len(a) == SKETCH or len(b) == SKETCH:
        low = low[:SKETCH]
    return 1.0 if not len(low) else float(np.isin(low, np.intersect1d(a, b), assume_unique=True).sum() / len(low))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two whole sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketches(docs: DataFrame, shingle: int = 5, whole: bool = True) -> DataFrame:
    """(doc_id, node, segs, sketch) of every row of docs, and the whole set; node is a hash of the set of shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("segs", pa.list_(pa.int32())), ("sketch", pa.binary()), ("whole", pa.binary())][: 4 + whole])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for a, b in in_parts(texts):
                words, counts = hashed_words(texts[a:b])
                ends, rows = np.cumsum(counts), []
                for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                    found = shingle_hashes(words[end - n : end], shingle)
                    place = np.arange(1, len(found) + 1, dtype=np.uint64) * _STEP
                    node = int(_mix(found + place).sum(dtype=np.uint64).view(np.int64))
                    rows.append((ids[a + i], node, segments(found).tolist(), sketch(found).tobytes(), found.astype("<u8").tobytes())[: 4 + whole])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, node long, segs array<int>, sketch binary" + ", whole binary" * whole)


def _at(slot: Column, step: int) -> Column:
    return F.get("segs", F.pmod(slot + step, F.lit(SEGMENTS)))


def _chain(x: str, y: str) -> Column:
    """Whether the chain from `slot` on keeps within its budgets."""

    def step(held: Column, l: Column) -> Column:
        at = F.pmod(F.col("slot") + l - 1, F.lit(SEGMENTS))
        total = held["total"] + (F.get(x, at) != F.get(y, at)).cast("int")
        return F.struct(total.alias("total"), (held["ok"] & (total <= F.floor(l * BUDGET / SEGMENTS))).alias("ok"))

    start = F.struct(F.lit(0).alias("total"), F.lit(True).alias("ok"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step, lambda held: held["ok"])


def _with_counts(keyed: DataFrame, name: str) -> DataFrame:
    """keyed(node, slot, key) whose key others share too, with their number n."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return materialize(keyed.join(shared, "key"), name)


def _pairs(met: DataFrame, segs: DataFrame) -> DataFrame:
    full = met.join(segs, "node").select("key", "slot", "node", "segs")
    a, b = full.alias("a"), full.alias("b")
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")))
    both = both.select(F.col("a.slot").alias("slot"), F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.segs").alias("x"), F.col("b.segs").alias("y"))
    return both.filter(_chain("x", "y")).select("a", "b")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float, name: str) -> DataFrame:
    """The pairs (a, b) whose sketches don't put them far below this similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = [similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= least - MARGIN for x, y in zip(frame["x"], frame["y"], strict=True)]
            yield frame.loc[ok, ["a", "b"]]

    left = pairs.distinct().join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long"), name)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("whole").alias("x")), "a")
    return left.join(sets.select(F.col("node").alias("b"), F.col("whole").alias("y")), "b")


def _exact(pairs: DataFrame, sets: DataFrame, least: float, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets have at least this similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = [overlap(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= least for x, y in zip(frame["x"], frame["y"], strict=True)]
            yield frame.loc[ok, ["a", "b"]]

    return materialize(_with_sets(pairs.distinct(), sets).select("a", "b", "x", "y").mapInPandas(run, "a long, b long"), name)


def _by_differences(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """groups(hub, node, c) -> pairs (a, b) of different c in a group, at least all that hold and aren't both linked to the hub."""
    share, more = (1 - least) / (1 + least), (1 - least) / least

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                sets_of = [(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(part["x"], part["y"], strict=True)]
                apart = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in sets_of]
                out = part[["hub", "node", "c"]].assign(size=[len(y) for _, y in sets_of], d=[len(d) for d in apart])
                out = out.loc[out.index.repeat(out["d"])].assign(token=np.concatenate(apart))
                yield out[["hub", "node", "c", "size", "d", "token"]]

    both = _with_sets(groups.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), "c"), sets)
    rows = both.select(F.col("a").alias("hub"), F.col("b").alias("node"), "c", "x", "y").mapInPandas(run, "hub long, node long, c long, size long, d long, token long")
    rows = materialize(rows, "differences")
    rows = rows.join(rows.groupBy("hub", "token").agg(F.count("*").alias("n")), ["hub", "token"])
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("hub", "node").orderBy("n", "token")))
    # |x ^ y| is at most share * (size_x + size_y), and at most more * size of either.
    rows = rows.filter((F.col("n") > 1) & (F.col("at") <= F.floor(F.col("size") * more + 1e-6) + 1)).withColumn("e", F.col("d") - share * F.col("size"))
    rows = materialize(rows, "prefixes")
    x, y = rows.filter(F.col("at") <= F.floor(F.col("size") * share + 1e-6) + 1).alias("x"), rows.alias("y")
    on = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.c") != F.col("y.c"))
    # Of x and y the one with the smaller e, d - share * size, has a shared token in the shorter prefix.
    on &= F.struct("x.e", "x.node") < F.struct("y.e", "y.node")
    on &= F.least("x.size", "y.size") >= least * F.greatest("x.size", "y.size") - 1e-6
    on &= F.abs(F.col("x.d") - F.col("y.d")) <= share * (F.col("x.size") + F.col("y.size")) + 1e-6
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def links(nodes: DataFrame, least: float = 0.8, pair_limit: int = 4, sets: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 3) -> DataFrame:
    """nodes(node, segs, sketch) -> links (a, b) that hold, enough to connect all texts that links connect.

    sets gives (node, whole) for a table of nodes (default: nodes has the column). Of crowded keys, hubs are tried for
    `rounds` rounds at most; that only saves work.
    """
    sets = sets or (lambda wanted: nodes.join(wanted, "node", "left_semi").select("node", "whole"))
    segs = nodes.select("node", "segs")
    keys = [F.struct(F.lit(i).alias("slot"), F.xxhash64(F.lit(2 * i + j), *(_at(F.lit(i), step) for step in (0, 1, 2 + j))).alias("key")) for i in range(SEGMENTS) for j in (0, 1)]
    first = _with_counts(nodes.select("node", F.explode(F.array(*keys)).alias("k")).select("node", "k.slot", "k.key"), "keys")
    likely = _likely(_pairs(first.filter(F.col("n") <= pair_limit), segs), nodes, least, "likely")
    crowd = first.filter(F.col("n") > pair_limit)
    wanted = likely.select(F.col("a").alias("node")).union(likely.select("b")).union(crowd.select("node"))
    whole = materialize(sets(wanted.distinct()), "sets")
    found = _exact(likely, whole, least, "links")
    if crowd.isEmpty():
        return found
    exact = lambda pairs, name: _exact(pairs, whole, least, name)
    return connect(crowd, found, exact, lambda groups: exact(_by_differences(groups, whole, least), "met"), rounds)


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id): texts whose sets of word shingles have a Jaccard similarity of `least` or more are linked;
    component_id is the smallest doc_id that links reach.

    Words are as in simhash.py; texts with equal sets are one node, those without words as well (null counts as empty).
    Rows with a null id are left out; repeated ids give repeated rows; an empty table gives an empty table; other columns
    of docs are not read.
    """
    return settled(lambda: _classes(docs.select("doc_id", "text").filter("doc_id is not null"), shingle, least), "classes")


def _classes(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    every = materialize(sketches(docs, shingle, whole=False), "sketches")
    heads = every.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = materialize(every.join(heads, ["node", "doc_id"], "left_semi").dropDuplicates(["node"]), "nodes")
    prints = materialize(every.select("doc_id", "node"), "prints")
    drop(every)

    def sets(wanted: DataFrame) -> DataFrame:
        """The whole sets of these nodes, from their texts."""
        ids = nodes.join(wanted, "node", "left_semi").select(F.col("doc_id").alias("id"))
        rows = sketches(docs.join(ids, F.col("doc_id").cast("long") == F.col("id"), "left_semi"), shingle)
        return rows.join(wanted, "node", "left_semi").select("node", "whole").dropDuplicates(["node"])

    comps = settled(lambda: connected_components(links(nodes, least, sets=sets)), "components")
    grouped = nodes.select("node", "doc_id").join(comps, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least_id = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = grouped.join(least_id, "component").select("node", "component_id")
    return prints.select("doc_id", "node").join(known, "node").select("doc_id", "component_id")
