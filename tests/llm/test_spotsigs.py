"""Spot signatures against a plain restatement, edited texts, and near-duplicate classes against all pairs."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from hyperslice.llm import nearcopies, queries, spotsigs
from hyperslice.llm.common import table

SF = "/root/testdata/sf0.001"


def spots(text):
    """Signatures as tuples of words."""
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    common = set(spotsigs.COMMON)
    found, ahead = set(), ()
    for w in reversed(words):
        if w in common:
            found.add((w, *ahead))
        else:
            ahead = (w, *ahead)[: spotsigs.CHAIN]
    found.add(("^", *ahead))
    return {s for s in found if len(s) > 1} or ({tuple(words)} if words else {text} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def restated(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own = spots(t)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), round(jaccard(own, spots(new)), 9), round(jaccard(own, spots(after)), 9)))
    return sorted(out, key=str)


def told(rows):
    return sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows], key=str)


def test_op11_equals_restatement(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.op11_fingerprints(spark, SF).collect()
    assert told(got) == restated(docs)
    by_text, texts = {}, dict(docs)
    for r in got:
        by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["fingerprint"])
        if r["edited_fingerprint"] == r["fingerprint"]:
            assert r["near_edited"] == 1.0
    assert all(len(f) == 1 for f in by_text.values()) and len({f for v in by_text.values() for f in v}) > 0.9 * len(by_text)


def test_odd_rows_and_clashing_names(spark):
    long = "the word goes " * 40_000
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (3, "The end"), (4, long), (5, "…!"), (None, "x ☃ y"), (None, None), (6, "the of and"), (7, "é" * 7), (-5, "To be, or not to be")]
    docs = spark.createDataFrame([(i, t, "z", 1, 2, "k") for i, t in rows], "doc_id long, text string, fingerprint string, block int, ahead int, key string")
    for blocks in (1, 2, 8):
        assert told(spotsigs.compare_edits(docs.repartition(5), blocks).collect()) == restated(rows)
    assert spotsigs.compare_edits(docs.limit(0), 4).count() == 0
    one = spotsigs.compare_edits(docs.filter("doc_id = 7"), 4).collect()
    assert told(one) == restated([(7, "é" * 7)]) and one[0]["near_next"] == 1.0
    classes = {r["doc_id"]: r["class_id"] for r in spotsigs.near_duplicates(docs.filter("doc_id is not null")).collect()}
    assert classes[1] == classes[2] == 1 and classes[3] in (3,) and spotsigs.near_duplicates(docs.limit(0)).count() == 0


def test_pruned_jaccard():
    import numpy as np

    r = random.Random(3)
    for _ in range(300):
        a, b = (np.array(sorted(r.sample(range(60), r.randint(0, 50))), np.uint64) for _ in range(2))
        want = jaccard(set(a.tolist()), set(b.tolist()))
        assert spotsigs.pruned_jaccard(a, b, block=7) == want
        least = r.random()
        assert spotsigs.pruned_jaccard(a, b, least, block=7) == (want if want >= least else 0.0) or want < least


def classes_of(texts, least):
    sets, root = [spots(t) for t in texts], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_near_duplicates_against_all_pairs(spark):
    """Copies, variants of one text at 0.6 to 1, crowded keys, and texts that share a passage only."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4)) if r.random() < 0.6 else r.choice(spotsigs.COMMON[:20])
    text = lambda n: [word() for _ in range(n)]
    base, passage = text(150), text(30)
    texts = [text(r.randint(1, 200)) for _ in range(60)]
    texts += [[w if r.random() > p else word() for w in base] for p in (0.0, 0.005, 0.01, 0.02, 0.03) for _ in range(22)]
    texts += [text(40) + passage for _ in range(45)] + [base[:120], base[:60]]
    texts = [" ".join(t) for t in texts] + [" ".join(base)] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes_of(texts, 0.8)
    for crowd in (4, 32):
        got = {x["doc_id"]: x["class_id"] for x in spotsigs.near_duplicates(docs, 0.8, crowd).collect()}
        assert got == want
    assert len(set(want.values())) < len(texts) - 60


def test_fingerprints_follow_prose(spark):
    """Half a text is found again, the next document isn't."""
    got = queries.op11_fingerprints(spark, SF).filter("n_chars > 400").agg(F.avg("near_edited").alias("edited"), F.expr("percentile(near_next, 0.9)").alias("next")).first()
    assert got["edited"] > 0.2 and got["next"] < 0.2


def test_near_copies_with_names_that_clash(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 5, "x"), (2, text, 6, "y"), (3, "other words", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, node string")
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == {1: 1, 2: 1, 3: 3}
