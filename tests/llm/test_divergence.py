"""Source divergences against a plain restatement in whole numbers."""

import re
from collections import Counter, defaultdict

from hyperslice.llm import divergence, queries
from hyperslice.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def restated(rows, least=3, top=200):
    count, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(c, kept=kept):
            size = sum(c[x] for x in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // size for t in kept}

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        own = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = {o: sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept) for o in sources - {s}}
            terms = {t: (own[s][t] - whole[t]) ** 2 // whole[t] for t in kept if count[lang, s][t] and own[s][t] > whole[t]}
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def told(df):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_op12_equals_restatement(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("lang", "source", "text").collect()]
    assert told(queries.op12_source_divergence(spark, sf)) == restated(rows)


def test_odd_rows_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LIMIT", 3)
    rows = [("en", "a", "One two ONE two two"), ("en", "a", "One two ONE two two"), ("en", None, "one É é 3 two"), ("en", "", "two éa"), ("en", "b", None), (None, None, "x y"), ("", "s", "x x-x"), (None, "s", "X"), ("fr", "only", "mot mot"), ("de", "p", "1 2"), ("de", "q", None)]
    rows += [("en", "c", "z" * 30_000 + " two" * 5_000)]
    df = spark.createDataFrame([(*r, "n", "p", 1) for r in rows], "lang string, source string, text string, term string, p string, n int")
    got = told(divergence.audit(df, top=2))
    assert got == restated(rows, top=2)
    assert {r[:4] for r in got} >= {("de", "p", "pair", "q"), ("de", "q", "pair", "p")} and all(r[4] == 0 for r in got if r[0] == "de")
    assert divergence.audit(df.limit(0)).count() == 0


def test_large_counts(spark):
    """Counts whose products pass 64 bits."""
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(10**12, 3 * 10**12, 7)], "n long, total long, size long")
    assert row.select(divergence.share(F.col("n"), F.col("total"), F.col("size")).alias("p")).first()["p"] == 1 + 10**9 * (10**12 + 1) // (3 * 10**12 + 7)
