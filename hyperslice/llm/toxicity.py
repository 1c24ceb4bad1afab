"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if term i occurs in the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

WORD = re.compile(r"[^\W_]+").findall
SLOTS = 1 << 22


def terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a word: itself, and its beginnings of 4 and 5 letters (inflected forms share them)."""
    found = [f"={word}"] + [f"{n}{word[:n]}" for n in (4, 5) if len(word) > n]
    return tuple(xxhash.xxh64_intdigest(t) % SLOTS for t in found)


def text_terms(text: str | None) -> np.ndarray:
    return np.array(sorted({t for w in set(WORD((text or "").lower())) for t in terms(w)}), np.int64)


@dataclass
class Model:
    slots: np.ndarray  # the hashed terms that are used, sorted
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, hit: list[int]) -> float:
        z = self.w0
        if hit:
            v = self.v[hit]
            total = v.sum(axis=0)
            z += float(self.w[hit].sum() + 0.5 * (total @ total - (v * v).sum()))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def _g(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """G-test of an occurrence in pos of n_pos and neg of n_neg rows against the label."""
    total, every = pos + neg, n_pos + n_neg
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * sum(np.where(c > 0, c * np.log(c * every / (np.maximum(total, 1) * n)), 0) for c, n in ((pos, n_pos), (neg, n_neg)))


def _together(rows: list[np.ndarray], toxic: np.ndarray, terms: np.ndarray) -> list[np.ndarray]:
    """In how many toxic rows, and in how many others, each pair of terms occurs together."""
    order = np.argsort(terms)
    found = []
    for y in (1, 0):  # one class at a time, so that one matrix is held
        own = np.flatnonzero(toxic == y)
        x = np.zeros((len(own), len(terms)), np.float32)
        for i, at in enumerate(own):
            x[i, order[np.isin(terms[order], rows[at], assume_unique=True)]] = 1
        found.append(x.T @ x)
    return found


def fit_sample(rows: list[np.ndarray], toxic: np.ndarray, prior: float, used: int = 2048, least: float = 20.0, factors: int = 8, epochs: int = 30, seed: int = 7, common: int = 1024, pairs: int = 256, least_pair: float = 40.0) -> Model:
    """Fit by Adam on the logistic loss. used, least: at most how many terms are kept, by how strong an association with
    the label (G-test), so that chance terms don't let the rows be learned by heart. common, pairs, least_pair: of the
    terms in most rows, those of at most so many pairs are kept too whose joint occurrence tells by so much more (G-test)
    of the label than each alone, so that terms which only tell together are seen by the interactions."""
    n_pos, n_neg = int(toxic.sum()), int(len(toxic) - toxic.sum())
    if not n_pos or not n_neg:
        return Model(np.zeros(0, np.int64), -3.0 if not n_pos else 3.0, np.zeros(0), np.zeros((0, factors)))
    known = np.unique(np.concatenate(rows))  # only terms that occur: the driver holds no table of all slots
    count = [np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)]
    for r, y in zip(rows, toxic):  # a row's terms differ
        count[0 if y == 1 else 1][np.searchsorted(known, r)] += 1
    seen = count[0] + count[1]
    gain = _g(count[0], count[1], n_pos, n_neg)
    best = np.argsort(-gain, kind="stable")[:used]
    often = np.argsort(-seen, kind="stable")[:common]
    both = _together(rows, toxic, known[often])
    a, b = np.triu_indices(len(often), 1)
    more = np.concatenate([_g(both[0][a[i], b[i]].astype(np.float64), both[1][a[i], b[i]].astype(np.float64), n_pos, n_neg) for i in np.array_split(np.arange(len(a)), 16)])
    more -= np.maximum(gain[often][a], gain[often][b])
    top = np.argsort(-more, kind="stable")[:pairs]
    top = top[more[top] >= least_pair]
    slots = np.unique(known[np.concatenate([best[gain[best] >= least], often[a[top]], often[b[top]]])]).astype(np.int64)
    x = np.zeros((len(rows), len(slots)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.flatnonzero(np.isin(slots, r, assume_unique=True))] = 1
    rng = np.random.default_rng(seed)
    par = [np.zeros(1), np.zeros(len(slots)), rng.normal(0, 0.01, (len(slots), factors))]
    mean, var = [np.zeros_like(a) for a in par], [np.zeros_like(a) for a in par]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            xb, y = x[part], toxic[part]
            xv = xb @ par[2]
            z = par[0][0] + xb @ par[1] + 0.5 * ((xv * xv).sum(1) - (xb @ (par[2] * par[2])).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(part)
            grads = [np.array([g.sum()]), xb.T @ g + 1e-4 * par[1], xb.T @ (g[:, None] * xv) - (xb.T @ g)[:, None] * par[2] + 1e-3 * par[2]]
            step += 1
            for i, grad in enumerate(grads):
                mean[i] = 0.9 * mean[i] + 0.1 * grad
                var[i] = 0.999 * var[i] + 0.001 * grad * grad
                par[i] -= 0.02 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.999**step)) + 1e-8)
    shift = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(n_pos / n_neg)
    return Model(slots, float(par[0][0] + min(0.0, shift)), par[1], par[2])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, max_rows: int = 3000) -> Model:
    """Fit on at most about `max_rows` labelled rows of each class (those with the smallest hashes of their ids; all if
    there are no more); rows where held_out(doc_id) is true, and null ids or labels, are not used. Of repeated labels the
    largest counts. The sample bounds what reaches the driver: terms only, no texts.
    """
    known = labels.filter("doc_id is not null and toxic is not null")
    if held_out is not None:
        known = known.filter(~held_out)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter("toxic in (0, 1)")
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003)
    chosen = known.filter(share < F.when(F.col("toxic") == 1, min(1.0, max_rows / max(1, size.get(1, 0)))).otherwise(min(1.0, max_rows / max(1, size.get(0, 0)))) + 1e-9)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "terms": [text_terms(t).astype(np.int32) for t in frame["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of rows that share an id, one
    got = one.mapInPandas(run, "doc_id long, toxic int, terms array<int>").toArrow()
    parts = [part for chunk in got.column("terms").chunks for part in _parts(chunk)]  # views of what was sent
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    n = sum(size.values())
    return fit_sample([parts[i] for i in order], got.column("toxic").to_numpy()[order].astype(np.float64), size.get(1, 0) / max(1, n))


def _parts(lists: pa.ListArray) -> list[np.ndarray]:
    """The rows of lists as arrays that share their memory."""
    flat, ends = lists.flatten().to_numpy(), np.cumsum(np.asarray(lists.value_lengths()))
    return [flat[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])), ends)]


def score(model: Model) -> object:
    """A function of a text column: the score of every whole text, 0 to 1; null and empty texts get the intercept's."""
    place = {int(s): i for i, s in enumerate(model.slots)}

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in batch:
                hit: set[int] = set()
                for w in set(WORD((text or "").lower())):
                    found = seen.get(w)
                    if found is None:
                        found = tuple(place[t] for t in terms(w) if t in place)
                        if len(w) <= 48:
                            if len(seen) > 100_000:
                                seen.clear()
                            seen[w] = found
                    if found:
                        hit.update(found)
                out.append(model.score(sorted(hit)))
            yield pd.Series(out, dtype="float64")

    return toxicity
