"""The language model's contexts: every word has a restaurant, and probabilities follow the seats."""

import math

import pytest

from hyperslice.llm import lm


@pytest.mark.parametrize("heads", [{}, {"head": 10, "pair_head": 0}])
def test_every_word_is_a_context(spark, heads):
    """More pairs than frequent words: the second word is told by the first in all of them (only 31 words were contexts)."""
    texts = spark.createDataFrame([(f"x{i} y{i}",) for i in range(60) for _ in range(5)], "text string")
    docs = spark.createDataFrame([(i + 100 * far, f"x{i} y{(i + far) % 60}") for i in range(60) for far in (0, 1)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, texts, **heads).collect()}
    assert all(got[i] > got[i + 100] + 1 for i in range(60))


@pytest.mark.parametrize("heads", [{}, {"head": 2, "pair_head": 0}, {"head": 0, "pair_head": 2}])
def test_scores_equal_brute_force(spark, heads):
    """Of one text all of whose pairs stand once every seat is certain; a restaurant's probabilities add up to one."""
    words = ["p", "q", "r", "s"]
    pairs = set(zip([None, *words], [*words, "END"], strict=True))
    d, theta, base = 0.95, 1.0, (1 - lm.UNKNOWN_SHARE) / 5
    parent = lambda w: ((1 - d) * (w in [*words, "END"]) + (theta + 5 * d) * (base if w in [*words, "END"] else lm.UNKNOWN_SHARE)) / (theta + 5)

    def p(u, w):
        seen = u is None or u in words
        return ((1 - d) / (theta + 1) if (u, w) in pairs else 0) + ((theta + d) / (theta + 1) if seen else 1) * parent(w)

    texts = ["p q r s", "q p", "", None, "z p q z", "s r q p s r", "p p p p"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, spark.createDataFrame([("p q r s",)], "text string"), **heads).collect()}
    for i, text in enumerate(texts):
        t = [*(text or "").split(), "END"]
        assert math.isclose(got[i], sum(math.log10(p(u, w)) for u, w in zip([None, *t[:-1]], t, strict=True)), abs_tol=1e-4)
    assert all(math.isclose(sum(p(u, w) for w in [*words, "END", "z"]), 1) for u in [None, *words, "z"])
