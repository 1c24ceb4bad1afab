"""Document fingerprints by spot signatures: chains of content words that follow common words.

A signature is a hash of an anchor (a common word of several languages, or the text's beginning) and the CHAIN content
words after it, SPOT apart; chains stop at the text's end. Layout, digits of navigation and lists hold few common words, so
a fingerprint follows the prose. A text of common words only has the hash of its words as its one signature, a text
without words the hash of its bytes; an empty or null text has none.

Sets are compared by Jaccard likeness. Sets of sizes a <= b can't be liker than a / b, so near_duplicates deals sets to
partitions by size and meets a set with its own and the next smaller partition only; pruned_jaccard stops as soon as the
least likeness is out of reach.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, slices
from .components import connected_components
from .groups import connect
from .hashing import ALNUM, _mix, hashed_words, in_parts

#: Common words of English, German, French and Spanish.
COMMON = (
    "the of and to a in is that it for was on with be by as this are at from an he or not but have had which you were they his her their has been "
    "der die und den von zu das mit sich auf des für ein ist nicht dem im als eine auch es werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que pour est qui par dans sur au pas avec ce il sont plus ne se "
    "el y los del las por no con su una para al lo como pero sus este entre cuando muy sin sobre"
).split()
CHAIN, SPOT = 3, 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ANCHORS = np.unique(hashed_words([w.encode() for w in COMMON], ALNUM)[0])
_BEGIN = np.uint64(0x51ED270B1F3A9C25)


def signatures(texts: list[bytes]) -> list[np.ndarray]:
    """The different signatures of each text, sorted."""
    words, counts = hashed_words(texts, ALNUM)
    ends = np.cumsum(counts)
    starts = ends - counts
    anchor = np.isin(words, _ANCHORS)
    content = np.flatnonzero(~anchor)
    before = np.concatenate(([0], np.cumsum(~anchor)))  # content words before each position
    at = np.flatnonzero(anchor)
    of = np.concatenate([np.arange(len(texts)), np.searchsorted(ends, at, side="right")])
    first = np.concatenate([before[starts], before[at]])
    value = np.concatenate([np.full(len(texts), _BEGIN), words[at]])
    last = before[ends][of]
    for j in range(CHAIN):
        k = first + SPOT * (j + 1) - 1
        inside = k < last
        word = np.zeros(len(k), np.uint64)
        word[inside] = words[content[k[inside]]]
        value = value * _STEP + word
    kept = first < last
    value, of = _mix(value[kept]), of[kept]
    order = np.argsort(of, kind="stable")
    parts = np.split(value[order], np.cumsum(np.bincount(of, minlength=len(texts)))[:-1])
    found = [np.unique(p) for p in parts]
    for i, text in enumerate(texts):
        if text and not len(found[i]):
            own = words[starts[i] : ends[i]].tobytes() or text
            found[i] = np.array([xxhash.xxh64_intdigest(own)], np.uint64)
    return found


def digest(found: np.ndarray) -> str:
    """32 hexadecimal digits of a set of signatures."""
    return hashlib.md5(found.astype("<u8").tobytes()).hexdigest()


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0, block: int = 4096) -> float:
    """Jaccard likeness of two sorted sets; 0 as soon as it is known to be under `least`. Two empty sets are equal."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    if len(a) < least * len(b):
        return 0.0
    both = 0
    for i in range(0, len(a), block):
        part = a[i : i + block]
        lo, hi = np.searchsorted(b, part[0]), np.searchsorted(b, part[-1], side="right")
        both += len(np.intersect1d(part, b[lo:hi], assume_unique=True))
        most = both + min(len(a) - i - len(part), len(b) - hi)
        if most < least * (len(a) + len(b) - most):
            return 0.0
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, signatures array<long>), a row for a row. Other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("signatures", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch]):
                texts = [(t or "").encode() for t in part["text"].to_pylist()]
                for a, b in in_parts(texts):
                    found = signatures(texts[a:b])
                    yield pa.record_batch([part["doc_id"][a:b], pa.array([digest(f) for f in found]), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string, signatures array<long>")


def followed(docs: DataFrame, blocks: int) -> DataFrame:
    """docs(doc_id, text) as (block, ahead, doc_id, text), sorted within partitions by block, doc_id (null first) and text; after a
    block's rows comes, with ahead = 1, the row that follows its last: the next block's first, after the last block the first.

    Blocks are ranges of ids between quantiles over all ids, so each text is shuffled once; rows of one id share a block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    cuts = rows.select(F.percentile_approx("key", [i / blocks for i in range(1, blocks)] or [0.5], max(10_000, 10 * blocks)).alias("cuts")).first()["cuts"] or []
    splits = [-math.inf, *sorted({float(c) for c in cuts} - {float(-(2**63))}), math.inf]
    place = Bucketizer(splits=splits, inputCol="at", outputCol="block") if len(splits) > 2 else None

    def placed(df: DataFrame) -> DataFrame:
        if place is None:
            return df.withColumn("block", F.lit(0))
        return place.transform(df.withColumn("at", F.col("key").cast("double"))).withColumn("block", F.col("block").cast("int")).drop("at")

    rows = placed(rows)
    least = rows.groupBy("block").agg(F.min("key").alias("key"))
    every = Window.orderBy("block")  # one row a block
    to = least.select("block", F.coalesce(F.lag("block").over(every), F.max("block").over(Window.partitionBy())).alias("to"), "key")
    heads = rows.join(F.broadcast(to), ["block", "key"]).groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
    both = rows.select("block", F.lit(0).alias("ahead"), "doc_id", "text").union(heads.select("to", F.lit(1), "doc_id", "text"))
    return both.repartitionById(len(splits) - 1, "block").sortWithinPartitions("block", "ahead", "doc_id", "text")


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"


def compare_edits(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are to each other and to the next document's.

    The edited text's last n_chars // 2 code points are replaced by as many of the next document's first (or all). Documents
    follow one another by doc_id, null ids first, rows of one id by text, after the last comes the first. Null texts count as
    empty; of two empty texts the likeness is 1. An empty table gives an empty table; other columns are not read. Rows are
    read in order and one document is held back at a time.
    """
    names = [c.split()[0] for c in EDITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (id, text, signatures) of the row before
        for batch in batches:
            for part in slices([batch], 64):
                ids, texts, ahead = part["doc_id"].to_pylist(), part["text"].to_pylist(), part["ahead"].to_pylist()
                raw = [t.encode() for t in texts]
                for a, b in in_parts(raw):
                    own = signatures(raw[a:b])
                    pairs = []
                    for i, found in zip(range(a, b), own):
                        if held is not None:
                            pairs.append((*held, texts[i], found))
                        held = None if ahead[i] else (ids[i], texts[i], found)
                    new = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, _, after, _ in pairs]
                    coded = [t.encode() for t in new]
                    sets = [f for x, y in in_parts(coded) for f in signatures(coded[x:y])]
                    out = [
                        (i, len(t), hashlib.sha256(code).hexdigest(), digest(f), digest(g), pruned_jaccard(f, g), pruned_jaccard(f, follows), len(f))
                        for (i, t, f, _, follows), code, g in zip(pairs, coded, sets)
                    ]
                    if out:
                        yield pa.RecordBatch.from_pandas(_frame(out, names), preserve_index=False)

    blocks = blocks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return followed(docs, blocks).mapInArrow(run, EDITS)


def _frame(rows: list[tuple], names: list[str]):
    import pandas as pd

    frame = pd.DataFrame(rows, columns=names)
    return frame.assign(doc_id=frame["doc_id"].astype("Int64"))


def near_duplicates(docs: DataFrame, least: float = 0.8, crowd: int = 32) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, class_id, n_links), a row for each document: class_id is the smallest
    doc_id reachable through links of likeness `least` and more, n_links the number of other fingerprints linked to its own
    (those that were compared: within a crowded key links are followed through hubs).

    Texts of equal fingerprint are one node. Nodes meet where they share one of their first signatures, rarest first (a pair
    of likeness `least` must), and lie in the same or the next partition of sizes. Where over `crowd` nodes meet at a key
    they are compared with hubs, and what no hub links through their differences from it; no link between classes is lost.
    Null ids take part and get the smallest id that they are linked to; repeated rows have one class.
    """
    found = materialize(fingerprints(docs), "spots")
    nodes = materialize(found.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("least_id"), F.first("signatures").alias("s")), "nodes")
    long = nodes.select("node", F.size("s").alias("n"), F.explode("s").alias("x"))
    counts = long.groupBy("x").agg(F.count("*").alias("df")).filter("df > 1")
    size = F.floor(F.log("n") / -math.log(least) + 1e-9).cast("int")
    order = Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "x")
    prefix = long.join(counts, "x", "left").withColumn("place", F.row_number().over(order))
    prefix = prefix.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).filter("df > 1").select("node", "n", "x", size.alias("part"))
    # A set lies in its own partition and is probed against the next smaller one: both rows have that partition's key.
    keys = prefix.select("node", F.explode(F.array(F.struct("part", "x"), F.struct((F.col("part") - 1).alias("part"), "x"))).alias("key"))
    at = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keys = materialize(keys.join(at, "key"), "keys")

    def exact(pairs: DataFrame, name: str) -> DataFrame:
        a, b = nodes.select(F.col("node").alias("a"), F.col("s").alias("sa")), nodes.select(F.col("node").alias("b"), F.col("s").alias("sb"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices([batch]):
                    sets = lambda c: [np.array(x, np.int64).view(np.uint64) for x in part[c].to_pylist()]
                    good = [pruned_jaccard(np.sort(x), np.sort(y), least) >= least for x, y in zip(sets("sa"), sets("sb"))]
                    yield pa.RecordBatch.from_arrays([part["a"], part["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        return materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a string, b string"), name)

    few = keys.filter(F.col("n") <= crowd).select("key", "node")
    met = few.alias("p").join(few.alias("q"), "key").filter("p.node < q.node").select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
    links = exact(met, "links")
    crowded = keys.filter(F.col("n") > crowd)
    if not crowded.isEmpty():
        links = materialize(connect(crowded, links, exact, lambda groups: exact(_apart(groups, nodes, least), "met")), "links")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    root = nodes.select("node", "least_id").join(connected_components(links), "node", "left").withColumn("root", F.coalesce("component", "node"))
    classes = root.groupBy("root").agg(F.min("least_id").alias("class_id"))
    told = root.join(classes, "root").join(degree, "node", "left").select(F.col("node").alias("fingerprint"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return found.select("doc_id", "fingerprint").join(told, "fingerprint").select("doc_id", "fingerprint", "class_id", "n_links")


def _apart(groups: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different components of groups(hub, node, c) that share one of the first signatures of their
    differences from the hub (rarest in the group first).

    |D(x) ^ D(y)| = |x ^ y| <= (1 - least) / (1 + least) * (|x| + |y|), where |y| <= |x| / least: at most k(x). Were D(x) and
    D(y) disjoint, both would be linked to the hub; else their rarest common signature has at most k(x) before it in D(x)
    and k(y) in D(y), which the other lacks.
    """
    of = nodes.select("node", "s")
    heads = nodes.select(F.col("node").alias("hub"), F.col("s").alias("h"))
    rows = groups.join(of, "node").join(heads, "hub")
    moved = rows.select("hub", "node", "c", F.size("s").alias("n"), F.array_union(F.array_except("s", "h"), F.array_except("h", "s")).alias("d"))
    k = F.floor(F.lit((1 - least) / (1 + least)) * F.col("n") * (1 + 1 / least) + 1e-9).cast("int")
    moved = materialize(moved.withColumn("k", k), "moved")
    long = moved.select("hub", "node", "c", "k", F.explode("d").alias("x"))
    counts = long.groupBy("hub", "x").agg(F.count("*").alias("df"))
    order = Window.partitionBy("hub", "node").orderBy("df", "x")
    first = long.join(counts, ["hub", "x"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("k") + 1).select("hub", "node", "c", "x")
    a, b = first.alias("a"), first.alias("b")
    on = (F.col("a.hub") == F.col("b.hub")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.c") != F.col("b.c"))
    return a.join(b, on).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
