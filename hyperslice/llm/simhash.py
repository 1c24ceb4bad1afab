"""SimHash near-duplicate detection with pigeonring filtering.

A fingerprint is split into distance + 1 segments on a ring. If two fingerprints differ in at most `distance` bits,
some segment i starts a chain whose first l segments differ in at most floor(l * distance / (distance + 1)) = l - 1
bits, for every l: segment i is equal, i and i + 1 together differ in at most one bit, and so on. So one half of
segment i + 1 is equal as well, and (i, segment i, that half) is an index key: 2 (distance + 1) rows a fingerprint.
Pairs that share a key must pass the whole chain before the full Hamming check.

Where more than `pair_limit` different fingerprints share a key, no pairs are formed: each fingerprint there is
written under every value within half the distance, and all that meet at one value are linked to one of them. That is
exact (two values within r1 and r2 = distance - r1 of a third are within distance, and the reverse), and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_words, materialize
from .components import connected_components

BITS = 64


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64; no words: 0."""
    words = ascii_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row of docs; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment; the first ones are wider where the bits don't divide evenly."""
    m = distance + 1
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _field(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keys(distance: int) -> Column:
    parts, out = _segments(distance), []
    for i, (shift, width) in enumerate(parts):
        after, wide = parts[(i + 1) % len(parts)]
        for half, (at, w) in enumerate(((after, wide // 2), (after + wide // 2, wide - wide // 2))):
            key = F.shiftleft(_field(F.col("fp"), shift, width), w).bitwiseOR(_field(F.col("fp"), at, w))
            out.append(F.struct(F.lit(2 * i + half).alias("slot"), key.alias("key")))
    return F.array(*out)


def _chain(distance: int, start: int) -> Column:
    """The chain test from segment `start` on the difference x of two fingerprints."""
    parts, total, ok = _segments(distance), F.lit(0), F.lit(True)
    for l in range(1, len(parts) + 1):
        total = total + F.bit_count(_field(F.col("x"), *parts[(start + l - 1) % len(parts)]))
        ok = ok & (total <= l * distance // (distance + 1))
    return ok


def links(nodes: DataFrame, distance: int = 2, pair_limit: int = 32) -> DataFrame:
    """nodes(rep, fp) with different fps -> edges (a, b) of reps that connect exactly what the pairs at `distance` connect."""
    keyed = nodes.select("rep", "fp", F.explode(_keys(distance)).alias("k")).select("rep", "fp", "k.slot", "k.key")
    shared = materialize(keyed.groupBy("slot", "key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    near = keyed.join(shared.filter(F.col("n") <= pair_limit), ["slot", "key"]).select("slot", "key", "rep", "fp")
    left, right = near.alias("l"), near.alias("r")
    pairs = left.join(right, (F.col("l.slot") == F.col("r.slot")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.rep") < F.col("r.rep")))
    pairs = pairs.select(F.col("l.slot").alias("slot"), F.col("l.rep").alias("a"), F.col("r.rep").alias("b"), F.col("l.fp").bitwiseXOR(F.col("r.fp")).alias("x"))
    chain = F.lit(False)
    for i in range(distance + 1):
        chain = chain | ((F.floor(F.col("slot") / 2) == i) & _chain(distance, i))
    pairs = pairs.filter(chain).filter(F.bit_count("x") <= distance).select("a", "b")
    r1 = distance // 2
    masks = [sum(1 << b for b in c) for r in range(distance - r1 + 1) for c in combinations(range(BITS), r)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    crowd = keyed.join(shared.filter(F.col("n") > pair_limit), ["slot", "key"], "left_semi").select("rep", "fp").distinct()
    spread = crowd.select("rep", "fp", F.explode(signed).alias("mask")).select("rep", F.col("fp").bitwiseXOR(F.col("mask")).alias("v"), (F.bit_count("mask") <= r1).alias("inner"))
    meet = spread.groupBy("v").agg(F.min(F.when(F.col("inner"), F.col("rep"))).alias("hub"), F.count("*").alias("n")).filter("n > 1 and hub is not null")
    stars = spread.join(meet, "v").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): fingerprints at most `distance` bits apart are linked; component_id is the smallest
    doc_id that links reach. Equal fingerprints are one node. Null or empty texts have fingerprint 0 and are linked like
    any other; rows with a null id are left out of the components (component_id null); repeated ids give repeated rows;
    an empty table gives an empty table; other columns of docs are not read.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = materialize(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    comps = connected_components(links(nodes, distance))
    heads = nodes.join(comps, nodes["rep"] == comps["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(heads, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
