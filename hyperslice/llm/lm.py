"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Words are seated in restaurants by context: every word that stands before another one has a restaurant of its own, as has
the beginning of a text. All restaurants share one parent, whose base measure gives unknown words a fixed share and the
known ones the rest alike. Gibbs sweeps reseat the customers of every (context, word) and every word of the parent by the
Chinese restaurant process, given the totals of the sweep before (a parallel sweep). A pair seen once always has one
table, so sweeps move only the others. Seats are averaged over several sweeps, which keeps each restaurant's
probabilities adding up to one.

Counts cover all training texts. A word's probability is that of the parent times the share that its context leaves to
it, and for a pair seen in training a factor of its own. So a text's score is a sum over its words and its pairs, which
are looked up apart. The `head` most frequent words and the `pair_head` most frequent pairs, bounded by these numbers, are
sent to the tasks; all others are looked up in buckets of the key, whose number grows with the tokens. Keys of one batch
of texts travel to a bucket, and its sums come back, as one row of arrays. Words are 59-bit hashes, pairs 63-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop, materialize, settled
from .hashing import hashed_words, in_parts

SHIFT = np.uint64(5)
START, END = np.uint64(0), np.uint64(1)
UNKNOWN_SHARE = 0.9
PER_BUCKET = 2_400_000
PER_CHUNK = 2_000_000


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(59-bit word hash of every token, tokens of each text); each text ends with one END."""
    h, counts = hashed_words(texts)
    words = np.full(len(h) + len(texts), END, np.uint64)
    words[np.arange(len(h)) + np.repeat(np.arange(len(texts)), counts)] = h >> SHIFT
    return words, counts + 1


def coded(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place i in known (sorted, not empty) as -1 - i; other words stay."""
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, -1 - at, words.view(np.int64))


def contexts(codes: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The word before each token, `start` at the first of a text."""
    before = np.concatenate(([start], codes[:-1]))
    before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = start
    return before


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Odd 64-bit keys of (context, word); those of words are even."""
    x = u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ x >> np.uint64(29)) + w.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32) | np.uint64(1)


def _ranges(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) in sorted keys; buckets are ranges of keys of equal width."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)])) if len(keys) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), int(a), int(b)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _flat(table: pa.Table, name: str, kind: type) -> np.ndarray:
    col = table.column(name).combine_chunks()
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1_000_000) -> Iterator[pa.Table]:
    """Batches put together to about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _counts(texts: DataFrame) -> DataFrame:
    """(w, n) of all texts, summed within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _encoded(batch.column(0))
            if data:
                parts = [np.unique(tokens(data[a:b])[0], return_counts=True) for a, b in in_parts(data, 1 << 20)]
                w, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(place, np.concatenate([p[1] for p in parts]), len(w)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

    return texts.select("text").mapInArrow(run, "w long, n long")


def _pairs(texts: DataFrame, known: np.ndarray, start: int, buckets: int) -> DataFrame:
    """(u, w, c): how often word w follows u, both coded, in all texts. Each batch's counts go to a bucket as one row."""
    sent = texts.sparkSession.sparkContext.broadcast(known)
    longs = pa.list_(pa.int64())

    def summed(u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        key = pair_keys(u, w)
        order = np.argsort(key)
        key = key[order]
        first = _starts(key)
        return key[first], u[order[first]], w[order[first]], np.add.reduceat(c[order], first) if len(first) else c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            u, w = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key, u, w, c = summed(u, w, np.ones(len(u), np.int64))
            for bucket, a, b in _ranges(key, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x[a:b]], longs) for x in (u, w, c))], names=["bucket", "u", "w", "c"])

        for batch in batches:
            data = _encoded(batch.column(0))
            for a, b in in_parts(data, 1 << 20):
                words, sizes = tokens(data[a:b])
                w = coded(words, sent.value)
                held.append((contexts(w, sizes, start), w))
                if sum(len(x) for _, x in held) >= PER_CHUNK:
                    yield from flush()
        if held:
            yield from flush()

    def reduce(group: pa.Table) -> pa.Table:
        _, u, w, c = summed(*(_flat(group, x, np.int64) for x in "uwc"))
        order = np.argsort(w)
        return pa.table({"u": u[order], "w": w[order], "c": c[order]})

    rows = texts.select("text").mapInArrow(run, "bucket int, u array<bigint>, w array<bigint>, c array<bigint>")
    return rows.groupBy("bucket").applyInArrow(reduce, "u long, w long, c long")


def seat(c: np.ndarray, parent: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after c customers of each word sit down one after another. A new table's weight is mass (concentration and
    the other words' tables) plus discount for each own table, times the parent's probability. From 32 customers on, a
    sixteenth of those seated come at once."""
    t, j = np.ones(len(c), np.int64), np.ones(len(c), np.int64)
    live = np.flatnonzero(c > 1)
    while len(live):
        seated, tables = j[live], t[live]
        come = np.minimum(np.maximum(1, seated // 16), c[live] - seated)
        new = (mass[live] + discount * tables) * parent[live]
        t[live] += rng.binomial(come, np.clip(new / (seated - discount * tables + new), 0, 1))
        j[live] += come
        live = live[j[live] < c[live]]
    return np.minimum(t, c)


def _tables(pairs: DataFrame) -> DataFrame:
    """pairs(u, w, t) -> (x, a, b): tables that word x has in all restaurants, and tables in the restaurant of x; several rows a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            u, w, t = (part.column(x).to_numpy() for x in "uwt")
            x, place = np.unique(np.concatenate([w, u]), return_inverse=True)
            a, b = (np.bincount(p, t, len(x)).astype(np.int64) for p in (place[: len(w)], place[len(w) :]))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(a), pa.array(b)], names=["x", "a", "b"])

    return pairs.select("u", "w", "t").mapInArrow(run, "x long, a long, b long")


#: Columns of the vocabulary: word, count, tables by _tables of pairs seen once, of all pairs, tables at the parent; their sums over samples.
VOCABULARY = ("x", "n", "a1", "b1", "a", "b", "r", "sa", "sb", "sr")


class Model:
    """Totals of the training texts, and over the kept sweeps; sums are by the columns of the vocabulary."""

    def __init__(self, vocabulary: int, total: int, texts: int, discounts: tuple[float, float], strength: float = 1.0):
        self.v, self.n, self.texts, self.d, self.d0, self.theta = vocabulary, total, texts, *discounts, strength

    def base(self) -> float:
        return (1 - UNKNOWN_SHARE) / max(1, self.v)

    def parent(self, a, r, all_a: float, all_r: float):
        """Probability of words (numbers, arrays or columns) that sit a times at the parent, at r tables."""
        return (a - r * self.d0 + (self.theta + self.d0 * all_r) * self.base()) / (self.theta + all_a)

    def unknown_parent(self, all_a: float, all_r: float) -> float:
        return (self.theta + self.d0 * all_r) * UNKNOWN_SHARE / (self.theta + all_a)


def _looked_up(pairs: DataFrame, vocabulary: DataFrame, p: Column, b: Column) -> DataFrame:
    """pairs with p of their word and b of their context, null where that is a head: rare words alone are joined."""
    rest = vocabulary.filter("x >= 0")
    for key, name, value in (("w", "p", p), ("u", "b", b)):
        head = pairs.filter(F.col(key) < 0).withColumn(name, F.lit(None).cast("double"))
        pairs = head.unionByName(pairs.filter(F.col(key) >= 0).join(rest.select(F.col("x").alias(key), value.cast("double").alias(name)).hint("shuffle_hash"), key))
    return pairs


def _heads(vocabulary: DataFrame, size: int, *columns: Column) -> list[np.ndarray]:
    rows = vocabulary.filter("x < 0").select("x", *(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns))).toArrow()
    out = [np.zeros(size) for _ in columns]
    for i, values in enumerate(out):
        values[-1 - rows.column("x").to_numpy()] = rows.column(f"c{i}").to_numpy()
    return out


def _filled(part: pa.Table, heads: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """p and b of _looked_up, with those of heads."""
    out = []
    for key, name, values in (("w", "p", heads[0]), ("u", "b", heads[1])):
        code = part.column(key).to_numpy()
        out.append(np.where(code < 0, values[np.maximum(-1 - code, 0)], part.column(name).to_numpy()))
    return out


def train(texts: DataFrame, head: int = 200_000, burn_in: int = 1, samples: int = 2) -> tuple[Model, np.ndarray, DataFrame, DataFrame, list[DataFrame]]:
    """The model's totals; its head words, sorted, with the texts' beginning; its vocabulary, of coded words; all
    pairs (u, w, c, t), t tables on average; and the written tables that these are in. Buckets hold about PER_BUCKET tokens."""
    spark = texts.sparkSession
    words = materialize(_counts(texts).groupBy("w").agg(F.sum("n").alias("n")), "words")
    size = words.agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.sum(F.when(F.col("w") == int(END), F.col("n"))).alias("texts")).first()
    known = np.unique(np.append(words.filter(_top(words, "n", head)).select("w").toArrow().column("w").to_numpy().astype(np.uint64), START))
    start = -1 - int(np.searchsorted(known, START))
    pairs = materialize(_pairs(texts, known, start, buckets_of(size["n"])), "pairs")
    sent = spark.sparkContext.broadcast(known)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(coded(batch.column(0).to_numpy().view(np.uint64), sent.value)), batch.column(1)], names=["x", "n"])

    zero = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    once = _tables(pairs.filter("c = 1").withColumn("t", F.col("c")))
    fixed = words.mapInArrow(code, "x long, n long").select("x", "n", *zero(*VOCABULARY[2:]))
    fixed = fixed.union(once.select("x", *zero("n"), F.col("a").alias("a1"), F.col("b").alias("b1"), *zero(*VOCABULARY[4:])))
    ones, twos = (lambda c, k=k: F.sum((F.col(c) == k).cast("long")) for k in (1, 2))
    rate = lambda c: F.coalesce(F.try_divide(ones(c), ones(c) + 2 * twos(c)), F.lit(0.0))
    d = [min(0.95, max(0.1, rows.agg(rate(c).alias("d")).first()["d"])) for rows, c in ((pairs, "c"), (words, "n"))]
    model = Model(size["v"], size["n"] or 0, size["texts"] or 0, (d[0], d[1]))

    def seated(vocabulary: DataFrame, moved: DataFrame, totals: tuple[float, float], number: int) -> DataFrame:
        """The vocabulary with the tables of moved pairs, and its customers at the parent seated again."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _gathered(batches):
                at = {c: part.column(c).to_numpy() for c in VOCABULARY}
                at["a"], at["b"] = at["a"] + at["a1"], at["b"] + at["b1"]
                if number < 0:
                    at["r"] = np.minimum(at["a"], 1)
                else:
                    rng = np.random.default_rng([number, 1, int(at["x"][0]) & 0xFFFFFFFF])
                    mass = model.theta + model.d0 * np.maximum(totals[1] - at["r"], 0)
                    at["r"] = seat(at["a"], np.full(len(at["a"]), model.base()), mass, model.d0, rng)
                if number >= burn_in:
                    at |= {f"s{c}": at[f"s{c}"] + at[c] for c in "abr"}
                yield pa.RecordBatch.from_arrays([pa.array(at[c]) for c in VOCABULARY], names=list(VOCABULARY))

        old = vocabulary.select("x", "n", "a1", "b1", *zero("a", "b"), "r", "sa", "sb", "sr")
        new = _tables(moved).select("x", *zero("n", "a1", "b1"), "a", "b", *zero("r", "sa", "sb", "sr"))
        rows = old.union(new).groupBy("x").agg(*(F.sum(c).alias(c) for c in VOCABULARY[1:]))
        return materialize(rows.mapInArrow(run, ", ".join(f"{c} long" for c in VOCABULARY)), "vocabulary")

    moved = pairs.filter("c > 1").select("u", "w", "c", F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("s"))
    vocabulary = seated(fixed, moved, (0, 0), -1)
    drop(words)
    for number in range(burn_in + samples):
        totals = tuple(float(x or 0) for x in vocabulary.agg(F.sum("a"), F.sum("r")).first())
        p, b = model.parent(F.col("a"), F.col("r"), *totals), F.col("b")
        heads = spark.sparkContext.broadcast(tuple(_heads(vocabulary, len(known), p, b)))

        def sweep(batches: Iterator[pa.RecordBatch], number: int = number, heads=heads) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for part in _gathered(batches):
                p, b = _filled(part, heads.value)
                u, w, c, t, s = (part.column(x).to_numpy() for x in ("u", "w", "c", "t", "s"))
                rng = np.random.default_rng([number, 0, int(w[0]) & 0xFFFFFFFF, int(u[0]) & 0xFFFFFFFF])
                t = seat(c, p, model.theta + model.d * np.maximum(b - t, 0), model.d, rng)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, w, c, t, s + t if number >= burn_in else s)], names=["u", "w", "c", "t", "s"])

        old = moved, vocabulary
        moved = materialize(_looked_up(moved, vocabulary, p, b).select("u", "w", "c", "t", "s", "p", "b").mapInArrow(sweep, "u long, w long, c long, t long, s long"), "seats")
        vocabulary = seated(vocabulary, moved, totals, number)
        for table in old:
            drop(table)
    tables = moved.select("u", "w", "c", (F.col("s") / samples).alias("t"))
    return model, known, vocabulary, pairs.filter("c = 1").select("u", "w", "c", F.lit(1.0).alias("t")).union(tables), [pairs, moved]


def _top(rows: DataFrame, column: str, most: int) -> Column:
    """A condition that the rows of the largest values meet, as many whole steps of an eighth of a doubling as hold at most `most` rows."""
    level = F.floor(F.log2(column) * 8).cast("int")
    least = 0
    for r in rows.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # at most 512 rows
        most -= r["n"]
        if most < 0:
            least = r["level"] + 1
            break
    return level >= least


def buckets_of(total: int | None) -> int:
    return 1 + (total or 0) // PER_BUCKET


def score(docs: DataFrame, texts: DataFrame, head: int = 200_000, pair_head: int = 1_000_000, **options: int) -> DataFrame:
    """Every row of docs(doc_id, text) scored by a model of texts(text): doc_id, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score (the model's), both log10 probabilities of the whole text.

    Null texts count as empty: one token, the end. Repeated rows are scored one by one, null ids too; other columns are
    not read. Without training texts all words are unknown. An empty table gives an empty table.
    """
    return settled(lambda: _score(docs, texts, head, pair_head, **options), "scores")


def _score(docs: DataFrame, texts: DataFrame, head: int, pair_head: int, **options: int) -> DataFrame:
    spark = docs.sparkSession
    model, known, vocabulary, pairs, tables_of = train(texts, head, **options)
    samples = options.get("samples", 2)
    buckets = buckets_of(model.n)
    start = -1 - int(np.searchsorted(known, START))
    mean = lambda c: F.col(c) / samples
    totals = tuple(float(x or 0) / samples for x in vocabulary.agg(F.sum("sa"), F.sum("sr")).first())
    parent, tables = model.parent(mean("sa"), mean("sr"), *totals), mean("sb")
    customers = F.when(F.col("x") == start, F.lit(model.texts)).otherwise(F.col("n"))
    left = F.log10((F.lit(model.theta) + tables * model.d) / (F.lit(model.theta) + customers))  # END is no context: neither tables nor customers
    place = np.searchsorted(known, END)
    end = -1 - int(place) if place < len(known) and known[place] == END else int(END)
    value = F.log10(parent) + F.when(F.col("x") == end, 0.0).otherwise(left)
    p, b, n, f, share = _heads(vocabulary, len(known), parent, tables, F.col("n"), value, left)
    heads, floor = spark.sparkContext.broadcast((p, b)), model.n + model.v + 1
    unknown = float(np.log10(model.unknown_parent(*totals)))

    def gain(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(key, log10 of what a pair's own seats multiply its probability by), sorted."""
        p, b = _filled(part, heads.value)
        u, w, c, t = (part.column(x).to_numpy() for x in ("u", "w", "c", "t"))
        key, g = pair_keys(u, w), np.log10(1 + (c - model.d * t) / ((model.theta + model.d * b) * p)).astype(np.float32)
        order = np.argsort(key)
        return key[order], g[order]

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            key, g = gain(part)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(g)], names=["key", "g"])

    longs, floats, shorts = pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.int16())

    def packed(key: np.ndarray, n: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        for bucket, a, b in _ranges(key, buckets):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([key[a:b].view(np.int64)], longs), pa.array([n[a:b]], longs), pa.array([g[a:b]], floats)], names=["bucket", "keys", "n", "g"])

    def pairs_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            key, g = gain(part)
            yield from packed(key, np.zeros(len(key), np.int64), g)

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            key = part.column("x").to_numpy().view(np.uint64) << SHIFT
            order = np.argsort(key)
            yield from packed(key[order], part.column("n").to_numpy()[order], part.column("f").to_numpy()[order].astype(np.float32))

    top = _top(pairs, "c", pair_head)
    found = _looked_up(pairs.filter(top), vocabulary, parent, tables).select("u", "w", "c", "t", "p", "b").mapInArrow(gains, "key long, g float").toArrow()
    top_key, top_g = found.column("key").to_numpy().view(np.uint64), found.column("g").to_numpy()
    order = np.argsort(top_key)
    sent = spark.sparkContext.broadcast((known, np.log10((n + 1) / floor), f, top_key[order], top_g[order]))
    kind = "bucket int, keys array<bigint>, n array<bigint>, g array<float>"
    rest = _looked_up(pairs.filter(~top), vocabulary, parent, tables).select("u", "w", "c", "t", "p", "b").mapInArrow(pairs_out, kind)
    rest = materialize(rest.union(vocabulary.filter("x >= 0").select("x", "n", value.alias("f")).mapInArrow(words_out, kind)), "factors")
    for written in (*tables_of, vocabulary):
        drop(written)
    first = float(share[-1 - start])
    names = ["chunk", "bucket", "keys", "doc", "times", "ids", "tokens", "known", "base", "score"]
    kinds = [pa.int64(), pa.int32(), longs, shorts, pa.list_(pa.int32()), longs, longs, longs, pa.list_(pa.float64()), pa.list_(pa.float64())]

    def row(*values: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, f, top_key, top_g = sent.value
        held: list[tuple[np.ndarray, ...]] = []
        chunk = docs_held = tokens_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """One row of what the heads give, and a row for every bucket that other keys go to."""
            ids, sizes, key, doc, *sums = (np.concatenate(x) for x in zip(*held, strict=True))
            yield row(chunk, chunk % buckets, None, None, None, pa.array(ids.tolist(), pa.int64()), sizes, *sums)
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            once = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(once, len(key))).astype(np.int32)
            key, doc = key[once], doc[once].astype(np.int16)
            for bucket, a, b in _ranges(key, buckets):
                yield row(chunk, bucket, key[a:b].view(np.int64), doc[a:b], times[a:b], None, None, None, None, None)

        for batch in batches:
            data, rids, ids = _encoded(batch.column(2)), batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            for a, b in ((x, min(x + 8192, b)) for a, b in in_parts(data, 1 << 20) for x in range(a, b, 8192)):
                if not held:
                    chunk, docs_held, tokens_held = int(rids[a]), 0, 0
                words, sizes = tokens(data[a:b])
                size, doc, w = b - a, np.repeat(np.arange(b - a), sizes), coded(words, known)
                hit = w < 0
                at = -1 - w[hit]
                k, s0, s1 = (np.bincount(doc[hit], v, size) for v in (np.ones(len(at)), base[at], f[at]))
                pair = pair_keys(contexts(w, sizes, start), w)
                if len(top_key):
                    at = np.minimum(np.searchsorted(top_key, pair), len(top_key) - 1)
                    met = top_key[at] == pair
                    s1 = s1 + np.bincount(doc[met], top_g[at[met]], size)
                else:
                    met = np.zeros(len(pair), bool)
                key = np.concatenate([pair[~met], words[~hit] << SHIFT])
                held.append((ids[a:b], sizes, key, np.concatenate([doc[~met], doc[~hit]]) + docs_held, k.astype(np.int64), s0, s1 + first))
                docs_held, tokens_held = docs_held + size, tokens_held + len(words)
                if tokens_held >= PER_CHUNK or docs_held >= 16384:  # numbers of texts are shorts
                    yield from flush()
                    held.clear()
        if held:
            yield from flush()

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """The sums by text of the keys of each row; rows of heads as they are."""
        key, n, g = _flat(right, "keys", np.int64).view(np.uint64), _flat(right, "n", np.int64), _flat(right, "g", np.float32)
        order = np.argsort(key)
        key, n, g = key[order], n[order], g[order].astype(np.float64)
        out = [left.filter(left.column("ids").is_valid()).select(["chunk", "doc", "ids", "tokens", "known", "base", "score"])]
        left = left.filter(left.column("keys").is_valid())
        for i in range(left.num_rows):
            one = left.slice(i, 1)
            own, doc, times = _flat(one, "keys", np.int64).view(np.uint64), _flat(one, "doc", np.int64), _flat(one, "times", np.int64)
            word = own & np.uint64(1) == 0
            count, value = np.zeros(len(own), np.int64), np.where(word, unknown, 0.0)
            if len(key):
                at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                met = key[at] == own
                count, value = np.where(met, n[at], 0), np.where(met, g[at], value)
            texts, place = np.unique(doc, return_inverse=True)
            sums = [np.bincount(place, times * v, len(texts)) for v in (count > 0, np.where(word, np.log10((count + 1) / floor), 0.0), value)]
            values = [one.column("chunk")[0].as_py(), texts.astype(np.int16), None, None, sums[0].astype(np.int64), *sums[1:]]
            out.append(pa.table([pa.array([v], k) for v, k in zip(values, [kinds[0], kinds[3], *kinds[5:]], strict=True)], names=out[0].column_names))
        return pa.concat_tables(x.cast(pa.schema(list(zip(out[0].column_names, [kinds[0], kinds[3], *kinds[5:]], strict=True)))) for x in out)

    def gather(group: pa.Table) -> pa.Table:
        told = group.column("ids").is_valid()
        one, more = group.filter(told), group.filter(pa.compute.invert(told))
        ids = one.column("ids").combine_chunks()
        ids = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        doc, sizes = _flat(more, "doc", np.int64), _flat(one, "tokens", np.int64)
        sums = [_flat(one, c, np.float64) + np.bincount(doc, _flat(more, c, np.float64), len(sizes)) for c in ("known", "base", "score")]
        return pa.table({"doc_id": ids, "n_tokens": sizes, "n_known": sums[0].round().astype(np.int64), "base_score": sums[1], "score": sums[2]})

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.mapInArrow(run, "chunk long, bucket int, keys array<bigint>, doc array<smallint>, times array<int>, ids array<bigint>, tokens array<bigint>, known array<bigint>, base array<double>, score array<double>")
    sums = parts.groupBy("bucket").cogroup(rest.groupBy("bucket")).applyInArrow(look_up, "chunk long, doc array<smallint>, ids array<bigint>, tokens array<bigint>, known array<bigint>, base array<double>, score array<double>")
    by = sums.groupBy("chunk").applyInArrow(gather, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return by.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
