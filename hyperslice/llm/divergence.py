"""How the sources of a language differ in their terms: smoothed integer shares and their divergences, exactly.

Terms are counted by a translate table: bytes.translate lowers A-Z and blanks all other ASCII characters but letters in one
pass, bytes.split cuts, a Counter per document gives a term's occurrences and that the document holds it. Tasks add up
counts by (lang, source, term) and let them go at LIMIT entries; Spark adds the rest. Only terms that occur are ever rows:
what a group lacks has the group's floor share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, slices

SCALE = 1_000_000_000
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LIMIT, BITS = 1_000_000, 32
GROUP_LIMIT = 1_000_000
COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    held: dict[tuple[str, str], dict[bytes, int]] = {}  # occurrences << BITS | documents

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in held.items():
            both = found.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array([x >> BITS for x in both], pa.int64()), pa.array([x & (1 << BITS) - 1 for x in both], pa.int64())],
                names,
            )
        held.clear()

    size = 0
    for batch in batches:
        for part in slices([batch]):
            for lang, source, text in zip(part["lang"].to_pylist(), part["source"].to_pylist(), part["text"].to_pylist()):
                found = held.setdefault((lang, source), {})
                before = len(found)
                get = found.get
                for word, n in Counter(terms(text)).items():
                    found[word] = get(word, 0) + (n << BITS) + 1
                size += len(found) - before + (not before)
                if size >= LIMIT:
                    yield from emit()
                    size = 0
    yield from emit()


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text), nulls as '' -> (lang, source, term, n, docs): occurrences, and rows of docs that hold the term."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + size)), exactly: products are decimals, as they pass 64 bits from 10^10 occurrences on."""
    top = (F.coalesce(n, F.lit(0)) + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, (total + size).cast("decimal(20,0)")).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): shares are at most SCALE + 1, so the square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(lang, source, text).

    part 'pair': the sum over the language's kept terms (in at least `least_docs` of its documents) of divergence(p, q), q the
    share in the other source `item`, for every other source. part 'term': the `top` terms with p > q, q the share in the
    whole language, and p's divergence from it. Nulls are ''; each row is a document, repeated or not; ties go by the item's
    UTF-8 bytes; an empty table gives an empty table; other columns are not read.
    """
    groups = materialize(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).groupBy("lang", "source").agg(F.count("*").alias("rows")), "groups")
    counts = materialize(term_counts(docs), "counts")
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = materialize(counts.drop("docs").join(whole, ["lang", "term"]), "kept")
    # Totals by group and by language; both are tables of one row a group.
    size = kept.groupBy("lang").agg(F.count_distinct("term").alias("size"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = groups.select("lang", "source").join(totals, ["lang", "source"], "left").join(size, "lang", "left").na.fill(0, ["total", "size"])
    stats = materialize(stats.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang"))), "stats")
    number = stats.count()
    if number > GROUP_LIMIT:
        raise ValueError(f"{number} groups of language and source: their pairs are the square of it, and tasks hold {GROUP_LIMIT} groups at most")
    shares = kept.join(F.broadcast(stats), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("size")).alias("p"), share(F.col("of_lang"), F.col("lang_total"), F.col("size")).alias("q")
    )
    floors = stats.select("lang", "source", F.when(F.col("size") > 0, share(F.lit(0), F.col("total"), F.col("size"))).alias("p0"), "size")
    pairs = _pairs(shares, floors).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    found = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").union(part(found, "term"))


def _pairs(shares: DataFrame, floors: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all sources of each language.

    value = size * f(p0, q0) + the sum over terms that either source holds of f(p, q) - f(p0, q0), p0 and q0 the floor shares.
    A term's row lists the sources that hold it; a task adds up its terms' corrections in one table of the sources of each
    language, by arrays: the work for a term is the sources that hold it by the language's sources. The floor shares
    go to the tasks with the code: one number a group, GROUP_LIMIT at most. All sums stay below (10^9 + 1) * (10^9 + size), as
    p / q is at most 10^9 + 1 and the shares of a group add up to 10^9 + size at most.
    """
    known: dict[str, tuple[dict[str, int], np.ndarray]] = {}
    for r in floors.filter("size > 0").orderBy("lang", "source").collect():
        names, p0 = known.setdefault(r["lang"], ({}, []))
        names[r["source"]] = len(names)
        p0.append(r["p0"])
    known = {lang: (names, np.array(p0, np.int64)) for lang, (names, p0) in known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = lambda p, q: (p - q) ** 2 // q
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices([batch], 2048):
                langs = np.array(part["lang"].to_pylist(), object)
                for lang in dict.fromkeys(langs):
                    names, p0 = known[lang]
                    table = sums.setdefault(lang, np.zeros((len(p0), len(p0)), np.int64))
                    held = part["held"].filter(pa.array(langs == lang))
                    row = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
                    source = held.flatten().field("source").dictionary_encode()
                    at = np.array([names[x] for x in source.dictionary.to_pylist()], np.int64)[source.indices.to_numpy()]
                    p = held.flatten().field("p").to_numpy()
                    every = np.tile(p0, (len(held), 1))
                    every[row, at] = p
                    for s in range(len(p0)):
                        own = at == s
                        mine = row[own]
                        table[s] += f(p[own, None], every[mine]).sum(axis=0) - len(mine) * f(p0[s], p0)
                        has = np.zeros(len(held), bool)
                        has[mine] = True
                        lack = ~has[row]
                        np.add.at(table[s], at[lack], f(p0[s], p[lack]) - f(p0[s], p0[at[lack]]))
        for lang, table in sums.items():
            names = list(known[lang][0])
            for i, name in enumerate(names):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array([name] * len(names)), pa.array(names), pa.array(table[i].tolist(), pa.int64())], ["lang", "source", "item", "more"])

    held = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p")).alias("held")).select("lang", "held")
    more = held.mapInArrow(run, "lang string, source string, item string, more long").groupBy("lang", "source", "item").agg(F.sum(F.col("more").cast("decimal(38,0)")).alias("more"))
    a = floors
    b = floors.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    every = a.join(b, "lang").filter("source <> item").join(more, ["lang", "source", "item"], "left")
    base = F.coalesce(F.col("size") * divergence(F.col("p0"), F.col("q0")).cast("decimal(20,0)"), F.lit(0))
    return every.select("lang", "source", "item", (base + F.coalesce("more", F.lit(0))).cast("long").alias("value"))
