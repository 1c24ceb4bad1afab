"""Line deduplication by a segment-partition edit join.

A line of length L is cut into t + 1 segments; a line within t edits keeps one of them unchanged, at a place at most t
off, so lines are indexed by (length, segment number, segment) and probe the indexes of lengths L - t to L with the few
substrings whose place fits (the multi-match-aware windows). From LONG characters on, lines share their segments with
all lines of up to twice a power-of-two scale: t + 1 segments of the first `scale` characters. Take the first segment i
for which the segments up to it hold at most i edits: it holds none, and the ones before it hold exactly i, so it stands
at most i places off. Lines that meet are
verified with a banded bit-parallel edit distance. Lines are compared with white space collapsed; those under `min_chars`
characters are left alone (op4_line_dedup and the pipeline take 1: all but empty lines), and those under EDITS_FROM are
compared for equality only.

Where more than `pair_limit` different lines meet at one key, they are not paired with each other but compared with hubs
among them (groups.py). Lines that no hub connects are reduced to the letter pairs in which they differ from those that
over half of their group's lines hold; the line that differs least is one more hub. Lines within t edits of one another differ in at most 4 t letter pairs, so their difference lists share one of the
first 4 t + 1 entries (prefix filter, rare pairs first) unless both lists have at most 4 t entries together; only such lines of different
components, whose lengths, parities and counts of letters and letter pairs allow t edits, are paired. No link is lost; each line takes the t of its own length, which is no less than that of a pair it is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, settled, slices, unused
from .components import connected_components
from .groups import connect


#: Lines this long may differ by edits; lines this long are indexed by scale and not by length.
EDITS_FROM, LONG = 20, 160
STEP = 32
BUCKETS = 4096


def edits_for(length: int) -> int:
    """Allowed edits between two lines of which the shorter has this length: 1 from 20 characters on, 2 from 80, 3 from 160, 4 from 320, and so on."""
    return 0 if length < EDITS_FROM else max(1, (length // 40).bit_length())


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _segment(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, width): the later ones are wider by one where the length doesn't divide evenly."""
    base, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        width = base + (i >= parts - more)
        out.append((at, width))
        at += width
    return out


@lru_cache(maxsize=256)
def _short_plan(length: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, seed, whether it is an index entry) of the substrings by which a line of this length meets lines under LONG."""
    out: dict[tuple[int, int, int], bool] = {}
    for shorter in range(length - edits_for(length), min(length + 1, LONG)):
        t, gap = edits_for(shorter), length - shorter
        if shorter < t + 1 or gap > t:
            continue
        for i, (start, width) in enumerate(_segment(shorter, t + 1)):
            low = max(0, start - i, start + gap - (t - i))
            high = min(length - width, start + i, start + gap + (t - i))
            for at in range(low, high + 1):
                place = (at, at + width, _digest(f"{shorter} {i}"))
                out[place] = out.get(place, False) or gap == 0 and at == start
    return [(*k, own) for k, own in out.items()]


@lru_cache(maxsize=64)
def _long_plan(scale: int) -> list[tuple[int, int, int, bool]]:
    """The same for lines of `scale` to 2 * scale characters."""
    t = edits_for(scale)
    parts = enumerate(_segment(scale, t + 1))
    return [(at, at + width, _digest(f"from {scale} {i}"), at == start) for i, (start, width) in parts for at in range(max(0, start - i), start + i + 1)]


def _plan(length: int) -> list[tuple[int, int, int, bool]]:
    if length < LONG:
        return _short_plan(length)
    scale = LONG << (length // LONG).bit_length() - 1
    shorter = edits_for(scale - 1) > length - scale  # lines of the scale below may be within reach
    return _long_plan(scale) + ((_short_plan(length) if scale == LONG else _long_plan(scale // 2)) if shorter else [])


BASE = 0x5851F42D4C957F2D
PART = 1 << 20


@lru_cache(maxsize=4096)
def _plan_arrays(length: int) -> tuple[np.ndarray, ...]:
    """_plan as columns: start, end, seed, and 1 for index entries; places beyond the line hold no whole segment."""
    plan = [p for p in _plan(length) if p[1] <= length]
    return tuple(np.array([p[i] for p in plan], kind) for i, kind in enumerate((np.int64, np.int64, np.uint64, np.uint64)))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for the places of one part."""
    both = [np.full(PART + 1, b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    for p in both:
        p[0] = 1
        np.cumprod(p, out=p)
    return both[0], both[1]


def _part_keys(lines: list[str], lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines(at): differences of one running sum over all letters, shifted to place 0, are the substrings' hashes."""
    ends = np.cumsum(lengths[at])
    code = np.frombuffer("".join([lines[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    power, inverse = _powers()
    if len(code) > PART:  # a single line
        power, inverse = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(code), b, np.uint64)))) for b in (power[1], inverse[1]))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * power[: len(code)])))
    plans = [_plan_arrays(n) for n in lengths[at].tolist()]
    start, end, seed, own = (np.concatenate(c) for c in zip(*plans, strict=True))
    sizes = np.array([len(p[0]) for p in plans])
    place = np.repeat(ends - lengths[at], sizes)
    start += place
    end += place
    x = ((total[end] - total[start]) * inverse[start] ^ seed) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) & ~np.uint64(1) | own
    return np.repeat(at, sizes), x


def keys_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, signed 64-bit key) for the keys of all lines; the lowest bit is 1 for index entries, 0 for probes."""
    lengths = np.array([len(x) for x in lines], np.int64)
    at = np.flatnonzero(lengths >= EDITS_FROM)
    part = (np.cumsum(lengths[at]) - 1) // (PART // 2) if len(at) else at
    out = []
    for group in np.split(at, np.flatnonzero(np.diff(part)) + 1) if len(at) else []:
        # Lines longer than half a part stand alone, so the others stay within one.
        long = lengths[group] > PART // 2
        for some in [group[~long], *(group[i : i + 1] for i in np.flatnonzero(long))]:
            if len(some):
                out.append(_part_keys(lines, lengths, some))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([n for n, _ in out]), np.concatenate([x for _, x in out]).view(np.int64)


def keys(line: str) -> list[int]:
    return keys_of([line])[1].tolist()


def within(a: str, b: str, t: int) -> bool:
    """Whether a and b are at most t edits apart: bit-parallel over b's letters, in a band of 2 t + 1 diagonals.

    After the equal ends are taken off, bit j of row e says that, with e edits, the letters of a read so far end on
    diagonal j - t of b. One shift and mask per edit count advance all diagonals at once.
    """
    if abs(len(a) - len(b)) > t:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return max(len(a), len(b)) <= t
    mask: dict[str, int] = {}
    for k, c in enumerate(b):
        mask[c] = mask.get(c, 0) | 1 << (k + t)
    width = (1 << (2 * t + 1)) - 1
    # rows[e]: bit d set <=> a[:k] matches b[:k + d - t] with e edits
    rows = [((1 << (e + 1)) - 1) << t & width for e in range(t + 1)]
    for k, c in enumerate(a):
        fits = mask.get(c, 0) >> k & width
        new = [rows[0] & fits]
        for e in range(1, t + 1):
            step = (rows[e] & fits) | rows[e - 1] | (rows[e - 1] >> 1)  # match; substitute; drop a's letter
            new.append((step | new[e - 1] << 1) & width)  # take b's letter
        rows = new
        if not rows[t]:
            return False
    end = len(b) - len(a) + t
    return any(r >> end & 1 for r in rows)


def _lines(text: str | None, min_chars: int) -> Iterator[tuple[int, str]]:
    """(line number, line with white space collapsed) of the lines of at least min_chars."""
    for no, raw in enumerate((text or "").split("\n")):
        line = " ".join(raw.split())
        if len(line) >= min_chars:
            yield no, line


def all_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, line_no, h, g, line): every line with the two halves of its 128-bit hash; its text once in each task at least."""
    out = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            rows, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for no, line in _lines(text, min_chars):
                    digest = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                    rows.append((doc, no, None if digest in seen else line))
                    seen.add(digest)
                    digests.append(digest)
            if len(seen) > 200_000:
                seen.clear()
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(cols[2], pa.string())], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, line_no int, h long, g long, line string")


def _met(lines: DataFrame) -> DataFrame:
    """lines(h, line) -> (h, key, n, mine): keys at which n lines meet, different ones among them and one at least by an index
    entry; mine is 1 for the lines that have one. Keys of many lines travel to a range of keys as one row of arrays; the
    ranges hold about 20,000 lines' keys each."""
    buckets = 1 + lines.count() // 20_000
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, value = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(value.view(np.uint64))
            h, value = h[order], value[order]
            bucket = ((value.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + 1]), pa.array([h[a:b]], longs), pa.array([value[a:b]], longs)], names=["bucket", "h", "value"])

        for batch in batches:
            for some in slices([batch], 1000):
                no, value = keys_of(some.column(1).to_pylist())
                held.append((some.column(0).to_numpy()[no], value))
                if sum(len(x) for _, x in held) >= 1_000_000:
                    yield from flush()
        if held:
            yield from flush()

    def meet(group: pa.Table) -> pa.Table:
        h, value = (np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in group.column(x).chunks)]) for x in ("h", "value"))
        order = np.argsort(value)  # index entries are the last of a key
        h, value = h[order], value[order]
        key = value >> 1
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(first, len(key)))
        kept = (np.minimum.reduceat(h, first) < np.maximum.reduceat(h, first)) & (value[first + sizes - 1] & 1 == 1)
        at = np.flatnonzero(np.repeat(kept, sizes))
        h, key, mine, n = h[at], key[at], value[at] & 1, np.repeat(sizes, sizes)[at]
        order = np.lexsort((-mine, h, key))
        h, key, mine, n = h[order], key[order], mine[order], n[order]
        once = (np.diff(h, prepend=h[:1]) != 0) | (np.diff(key, prepend=key[:1]) != 0)
        once[:1] = True
        return pa.table({"h": h[once], "key": key[once], "n": n[once], "mine": mine[once]})

    rows = lines.select("h", "line").mapInArrow(run, "bucket long, h array<bigint>, value array<bigint>")
    return rows.groupBy("bucket").applyInArrow(meet, "h long, key long, n long, mine long")


def counted(line: str) -> tuple[np.ndarray, np.ndarray]:
    """How often letter pairs hashed to each of 128 buckets and letters hashed to each of 64 occur.

    An edit takes away and brings at most two pairs, and one letter at most.
    """
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount((code[:-1] * np.uint32(37) + code[1:] * np.uint32(101)) % 128, minlength=128), np.bincount(code % 64, minlength=64)


def parity(pairs: np.ndarray, letters: np.ndarray) -> list[int]:
    """Bit i of the first two: whether the letter pairs of bucket i are odd in number; of the last: the letters.

    An edit flips at most four bits of the pairs and two of the letters.
    """
    both = np.concatenate([pairs, letters]) & 1
    return np.packbits(both.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def numbered_pairs(line: str) -> np.ndarray:
    """The line's letter pairs as a sorted set of 32-bit hashes of (pair, how often it stood before).

    Lines within t edits differ in at most 4 t of them; hashes that collide only make differences smaller.
    """
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pair = np.sort(code[:-1] << np.uint64(21) | code[1:])
    number = np.arange(len(pair), dtype=np.uint64)
    first = np.maximum.accumulate(np.where(np.append(True, pair[1:] != pair[:-1])[: len(pair)], number, np.uint64(0)))
    return np.unique((_mixed(_mixed(pair) + (number - first)) >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _common(lines: DataFrame) -> np.ndarray:
    """In how many lines(line) the numbered letter pairs of each of BUCKETS occur."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(BUCKETS, np.int64)
        for frame in frames:
            for line in frame["line"]:
                count[np.unique(numbered_pairs(line) % BUCKETS)] += 1
        yield pd.DataFrame({"bucket": np.flatnonzero(count), "n": count[count > 0]})

    found = lines.select("line").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"]
    return out


def _profiles(rows: DataFrame) -> DataFrame:
    """rows(line, group) -> (group, usual): the numbered letter pairs that over half of a group's lines hold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, some in frame.groupby("group"):
                x, k = np.unique(np.concatenate([numbered_pairs(line) for line in some["line"]]), return_counts=True)
                yield pd.DataFrame({"group": group, "x": x, "k": k.astype(np.int64)})

    held = rows.select("group", "line").mapInPandas(run, "group long, x int, k long").groupBy("group", "x").agg(F.sum("k").alias("k"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("size"))
    # A group's usual pairs are at most twice as many as its mean line has.
    return held.join(sizes, "group").filter(F.col("k") * 2 > F.col("size")).groupBy("group").agg(F.array_sort(F.collect_list("x")).alias("usual"))


def _apart(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """rows(h, c, t, line, group, usual) -> (h, c, t, group, d, tokens): d letter pairs in which a line differs from the usual
    ones of its group, tokens for the first 4 t + 1 of them, rare ones first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for h, c, t, line, group, usual in frame[["h", "c", "t", "line", "group", "usual"]].itertuples(index=False):
                own, usual = numbered_pairs(line), np.zeros(0, np.int32) if usual is None else np.asarray(usual, np.int32)
                more, less = np.setdiff1d(own, usual, assume_unique=True), np.setdiff1d(usual, own, assume_unique=True)
                # One order for all lines of a group: pairs that are not usual, rare ones first, then usual ones that are missing.
                diff = np.concatenate([more[np.lexsort((more, common[more % BUCKETS]))], np.sort(less)])
                tokens = _mixed(diff[: 4 * t + 1].astype(np.int64).view(np.uint64) ^ _mixed(np.array([group], np.int64).view(np.uint64)))
                out.append((h, c, t, group, len(diff), tokens.view(np.int64)))
            yield pd.DataFrame(out, columns=["h", "c", "t", "group", "d", "tokens"])

    return materialize(rows.mapInPandas(run, "h long, c long, t long, group long, d long, tokens array<long>"), "differences")


def _pairs(met: DataFrame, by: str, *more: Column) -> DataFrame:
    """Pairs of lines that meet at a key and whose lengths, parities and counts allow the edits of the shorter one."""
    a, b = met.alias("a"), met.alias("b")
    t = F.least("a.t", "b.t")
    odd = lambda c: F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")))
    on = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.h") < F.col("b.h")) & (F.abs(F.col("a.n") - F.col("b.n")) <= t)
    on &= (odd("odd") + odd("odd2") <= 4 * t) & (odd("letters") <= 2 * t)
    for condition in more:
        on &= condition
    gained = lambda x, y, c: F.aggregate(F.zip_with(f"{x}.{c}", f"{y}.{c}", lambda i, j: F.greatest((i - j).cast("int"), F.lit(0))), F.lit(0), lambda k, i: k + i)
    for c, each in (("counts", 1), ("pairs", 2)):
        on &= (gained("a", "b", c) <= each * t) & (gained("b", "a", c) <= each * t)
    return a.join(b, on).select(F.col("a.h").alias("a"), F.col("b.h").alias("b")).distinct()


FILTERS = ("n", "t", "odd", "odd2", "letters", "counts", "pairs")


def _odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1000):
        lines = batch.column(1).to_pylist()
        tallies = [counted(x) for x in lines]
        rows = np.array([(len(x), edits_for(len(x)), *parity(*both)) for x, both in zip(lines, tallies, strict=True)], np.int64).reshape(-1, len(FILTERS) - 2)
        # Counts above 127 are cut to it: their differences can only shrink.
        letters, pairs = (pa.array([np.minimum(x, 127).astype(np.int8) for x in side], pa.list_(pa.int8())) for side in (([y[:32] + y[32:] for _, y in tallies]), [x for x, _ in tallies]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in rows.T), letters, pairs], names=["h", "line", *FILTERS])


def similar_lines(lines: DataFrame, pair_limit: int = 4) -> DataFrame:
    """lines(h, line) -> links (a, b) between the hashes of different lines, enough to connect all lines that are linked
    through pairs within the allowed edits."""
    met = materialize(_met(lines), "met")
    texts = lines.join(met.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    texts = materialize(texts.mapInArrow(_odds, "h long, line string, " + ", ".join(f"{c} {'array<tinyint>' if c in ('counts', 'pairs') else 'long'}" for c in FILTERS)), "texts")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = [within(x, y, edits_for(min(len(x), len(y)))) for x, y in zip(frame["x"], frame["y"], strict=True)]
            yield frame.loc[ok, ["a", "b"]]

    def exact(pairs: DataFrame, name: str) -> DataFrame:
        left = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a")
        both = left.join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
        return materialize(both.select("a", "b", "x", "y").mapInPandas(check, "a long, b long"), name)

    def rest(groups: DataFrame) -> DataFrame:
        told = groups.select(F.col("node").alias("h"), "c", F.col("hub").alias("group")).join(texts.select("h", "t", "line"), "h")
        told = materialize(told, "told")
        apart = _apart(told.join(_profiles(told), "group", "left"), _common(told))
        # The line nearest to its group's usual pairs is one more hub; components that it links count as one.
        middle = apart.groupBy("group").agg(F.min(F.struct("d", "h", "c")).alias("m")).select("group", F.col("m.d").alias("md"), F.col("m.h").alias("mh"), F.col("m.c").alias("mc"))
        near = apart.join(middle, "group").filter((F.col("c") != F.col("mc")) & (F.col("d") - F.col("md") <= 4 * F.col("t")))
        stars = exact(near.select(F.col("mh").alias("a"), F.col("h").alias("b")).distinct(), "stars")
        one = near.join(stars.select(F.col("a").alias("mh"), F.col("b").alias("h")), ["mh", "h"]).select("group", "c", "mc").distinct()
        apart = apart.join(one, ["group", "c"], "left").withColumn("c", F.coalesce("mc", "c"))
        few = F.when(F.col("d") <= 4 * F.col("t"), F.struct(F.lit(1).alias("at"), F.lit(1).alias("few"), F.xxhash64("group").alias("token")))
        entries = F.transform("tokens", lambda x, i: F.struct((i + 1).alias("at"), F.lit(0).alias("few"), x.alias("token")))
        apart = apart.select("h", "c", "d", F.explode(F.concat(entries, F.array_compact(F.array(few)))).alias("x")).select("h", "c", "d", "x.*")
        over = Window.partitionBy("token")
        apart = apart.withColumns({"lo": F.min("c").over(over), "hi": F.max("c").over(over)}).filter("lo < hi").drop("lo", "hi")
        apart = materialize(apart, "tokens")
        # Lists of a and b entries share (a + b - 4 t) / 2 at least: one of them is among the first 2 t + 1 of the shorter list.
        most = 4 * F.least("a.t", "b.t")
        short, long = (F.struct(f"{x}.d", f"{x}.h") for x in "ab")
        # What is shared stands before, at or behind the token met, in both lists.
        room = F.least("a.at", "b.at") + F.least(F.col("a.d") - F.col("a.at"), F.col("b.d") - F.col("b.at")) >= (F.col("a.d") + F.col("b.d") - most) / 2
        first = room & (F.when(short < long, F.col("a.at")).otherwise(F.col("b.at")) <= most / 2 + 1)
        fits = (F.abs(F.col("a.d") - F.col("b.d")) <= most) & F.when(F.col("a.few") == 0, first).otherwise(F.col("a.d") + F.col("b.d") <= most)
        return stars.union(exact(_pairs(apart.join(texts.select("h", *FILTERS), "h"), "token", F.col("a.c") != F.col("b.c"), fits), "met"))

    # Crowded keys are split by length: steps of so many characters, and the step below for lines within reach of it.
    lengths = F.array_distinct(F.array(F.floor(F.col("len") / STEP), F.floor((F.col("len") - F.col("t")) / STEP)))
    crowd = met.filter(F.col("n") > pair_limit).select("h", "key", "mine").join(texts.select("h", F.col("n").alias("len"), "t"), "h")
    crowd = crowd.select("h", "key", "mine", F.explode(lengths).alias("step")).select("h", "mine", F.xxhash64("key", "step").alias("key")).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    crowd = materialize(crowd.filter("n > 1"), "crowd")
    few = met.filter(F.col("n") <= pair_limit).select("h", "key").union(crowd.filter(F.col("n") <= pair_limit).select("h", "key"))
    found = exact(_pairs(few.join(texts.select("h", *FILTERS), "h"), "key"), "links")
    crowd = crowd.filter(F.col("n") > pair_limit)
    return found if crowd.isEmpty() else connect(crowd.select(F.col("h").alias("node"), "key", (F.col("n") * F.col("mine")).alias("n")), found, exact, rest, rounds=1)


def repeated(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc_id, line_no, class_doc, class_line): every line that repeats an earlier one, and its class's first line.

    Lines are numbered from 0. A class is what links within the allowed edits connect (equal lines are linked); its first
    line is the one of the smallest (doc_id, line_no). Lines under min_chars and rows with a null id are left out.
    """
    lines = materialize(all_lines(docs.filter("doc_id is not null"), min_chars), "lines")
    places = lines.drop("line")
    links = settled(lambda: connected_components(similar_lines(lines.filter("line is not null").select("h", "line"))), "components")
    links = links.select(F.col("node").alias("h"), "component")
    roots = links.select(F.col("component").alias("h"), "component").distinct()
    # Lines are equal if all 128 bits are; only links go by the first half.
    first = places.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    first = first.join(links.union(roots), "h", "left").withColumn("class", F.when(F.col("component").isNull(), F.struct("h", "g")).otherwise(F.struct(F.col("component").alias("h"), F.lit(0).cast("long").alias("g"))))
    heads = first.groupBy("class").agg(F.min("first").alias("head"), F.sum("n").alias("n")).filter("n > 1")
    known = first.select("h", "g", "class").join(heads, "class").select("h", "g", F.col("head.doc_id").alias("class_doc"), F.col("head.line_no").alias("class_line"))
    return places.join(known, ["h", "g"]).filter("doc_id <> class_doc or line_no <> class_line").select("doc_id", "line_no", "class_doc", "class_line")


def dedup(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """docs without their repeated lines: same columns, text without them; all of a document's other lines stay in order.

    A document none of whose text is left is dropped; documents that had no text before stay as they are, as do those
    with null ids or texts. n_chars, where there is one, is that of the new text. Rows that repeat an id share their
    lines' numbers; each loses the lines found repeated under it. An empty table gives an empty table.
    """
    gone_, id_ = unused(docs, "gone"), unused(docs, "id")
    gone = settled(lambda: repeated(docs, min_chars).groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("line_no").alias(gone_)), "gone")
    rows = docs.join(gone, F.col("doc_id").cast("long") == F.col(id_), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(gone_, i)), "\n")
    rows = rows.withColumn("text", F.when(F.col(gone_).isNull(), F.col("text")).otherwise(left))
    rows = rows.filter(F.col(gone_).isNull() | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(gone_).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*docs.columns)
