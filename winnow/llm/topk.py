"""Exact top-k by integer inner product: term-at-a-time accumulation into dense arrays of scores."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.blocks import search, usable

_TOGETHER = 64  # queries whose score arrays are filled at once


def codes(rows: np.ndarray, scale: int, exact: bool) -> np.ndarray:
    """floor(scale * x) of each component, in 64 bits or, if exact, in Python's integers: doubles from 2 ** 53 are whole."""
    if not exact:
        return np.floor(rows * scale).astype(np.int64)
    made = [scale * int(x) if abs(x) >= 2.0**53 else floor(scale * x) for x in rows.ravel().tolist()]
    return np.array([*made, None], object)[:-1].reshape(rows.shape)


def best_by_terms(k: int, q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, scale: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k highest rows: for every term of a query, its weight times the term's postings is added into the
    score array of the block; the k-th highest is then found by partition, and ties go to smaller ids.

    Sums are exact: in 64 bits, or in Python's integers where a bound on them exceeds that. Scores beyond 64 bits become the
    nearest 64-bit integer, and rank as such.
    """
    most = [float(np.abs(x).max(initial=0)) * scale + 1 for x in (queries, rows)]
    wide = not most[0] * most[1] * rows.shape[1] < 2**62
    kind = object if wide else np.int64
    queries, rows = codes(queries, scale, wide), codes(rows, scale, wide)
    postings = [np.flatnonzero(rows[:, t]) for t in range(rows.shape[1])]
    weights = [rows[p, t] for t, p in enumerate(postings)]
    for start in range(0, len(queries), _TOGETHER):
        part = queries[start : start + _TOGETHER]
        scores = np.zeros((len(part), len(rows)), kind)
        for t, (at, w) in enumerate(zip(postings, weights, strict=True)):
            asked = np.flatnonzero(part[:, t])
            if not len(asked) or not len(at):
                continue
            if len(at) == len(rows) and len(asked) == len(part):
                scores += part[:, t, None] * w
            else:
                scores[np.ix_(asked, at)] += part[asked, t, None] * w
        if wide:
            scores = np.clip(scores, -(2**63) + 1, 2**63 - 1).astype(np.int64)
        for i in range(len(part)):
            others = np.flatnonzero(ids != q_ids[start + i])
            own = scores[i][others]
            if len(own) > k:
                least = np.partition(own, len(own) - k)[len(own) - k]
                above = np.flatnonzero(own >= least)
                # ids ascend within a block, so a stable sort settles ties
                others, own = others[above], own[above]
                order = np.argsort(-own, kind="stable")[:k]
                others, own = others[order], own[order]
            yield start + i, others, own


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    Components become floor(scale * x) in double precision. Queries are the rows whose vec_id is divisible by `every`.
    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without vec_id. An id
    is one vector: rows that share a query's vec_id are its own, and of rows with one vec_id the greatest vector counts.
    Vectors of different lengths aren't compared. Scores beyond 64 bits are given, and rank, as the nearest 64-bit integer. Ties go to the smaller vec_id; extra columns are ignored; an empty
    table gives an empty result.
    """
    rows = usable(vectors, zero_too=True).groupBy("vec_id").agg(F.max("vec").alias("vec"))
    rows = rows.withColumn("dim", F.size("vec"))

    def best(*args: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return best_by_terms(k, *args, scale)

    return search(rows, F.col("vec_id") % every == 0, k, best, "long", ascending=False)
