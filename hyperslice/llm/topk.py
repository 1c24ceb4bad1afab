"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows. Candidates are packed into blocks of postings by term (dimension), queries into
blocks of rows; every query block meets every candidate block, where each query's non-zero weights scatter weighted
postings into a dense score array, and the k best of the block are selected. A last step merges the blocks' selections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

SCALE = 256


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """(ids binary, values binary, dims int): blocks of at most `size` vectors of one length, as int64."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}

        def block(dims: int) -> pd.DataFrame:
            ids, vectors = held.pop(dims)
            whole = np.floor(SCALE * np.asarray(vectors, np.float64).reshape(len(ids), dims)).astype(np.int64)
            return pd.DataFrame({"ids": [np.asarray(ids, np.int64).tobytes()], "vals": [whole.tobytes()], "dims": [dims]})

        for frame in frames:
            for i, v in zip(frame["vec_id"].tolist(), frame["embedding"], strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield block(len(v))
        for dims in list(held):
            yield block(dims)

    return rows.mapInPandas(run, "ids binary, vals binary, dims int")


def _score(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_ids, q_vals, ids, vals, dims in frame[["q_ids", "q_vals", "ids", "vals", "dims"]].itertuples(index=False):
                queries, cands = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                weights = np.frombuffer(q_vals, np.int64).reshape(len(queries), dims)
                order = np.argsort(cands, kind="stable")  # ties go to the smaller id
                cands, matrix = cands[order], np.frombuffer(vals, np.int64).reshape(len(cands), dims)[order]
                postings = []
                for j in range(dims):
                    rows = np.flatnonzero(matrix[:, j])
                    postings.append((None if 2 * len(rows) > len(cands) else rows, np.ascontiguousarray(matrix[:, j] if 2 * len(rows) > len(cands) else matrix[rows, j])))
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for q, row in zip(queries, weights, strict=True):
                    acc = np.zeros(len(cands), np.int64)
                    for j in np.flatnonzero(row):
                        rows, column = postings[j]
                        if rows is None:
                            acc += row[j] * column
                        else:
                            acc[rows] += row[j] * column
                    live = np.flatnonzero(cands != q)
                    score = acc[live]
                    if len(live) > k:
                        least = np.partition(score, len(live) - k)[len(live) - k]
                        above, equal = np.flatnonzero(score > least), np.flatnonzero(score == least)
                        pick = np.concatenate([above, equal[: k - len(above)]])
                    else:
                        pick = np.arange(len(live))
                    out.append((np.full(len(pick), q), cands[live[pick]], score[pick]))
                if out:
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, query_block: int = 1024, block: int = 8192, salts: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of `vectors` for every row of `queries`, ties to the smaller vec_id.

    Both have (vec_id, embedding). A component x counts as floor(256 x). Vectors that are null, or hold null or
    non-finite components, and rows with a null id take no part; vectors of another length than the query's are not
    scored; a query's own id is never its result; with fewer than k candidates all are returned; repeated ids count as
    rows of their own; empty tables give an empty table. Components must fit 64-bit sums of products.
    Every query block is sent to each of `salts` groups of candidate blocks, so no key holds more than its share.
    """
    fit = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    pick = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    asked = _pack(queries.select(*pick).filter(fit), query_block)
    asked = asked.select(F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals"), "dims", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    cands = _pack(vectors.select(*pick).filter(fit), block).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    met = cands.join(asked, ["dims", "salt"])
    best = met.mapInPandas(_score(k), "query_id long, vec_id long, score long")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
