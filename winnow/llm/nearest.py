"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, then exact distances for the survivors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.blocks import search, usable

_SLACK = 1e-6  # relative room for rounding in the bounds themselves
_EXACT_DIMS = 1024  # 127 * 127 * 1024 < 2 ** 24: a float32 product of int8 numbers is exact up to here


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the error) of each row."""
    scale = np.abs(rows).max(axis=1) / 127
    scale[scale == 0] = 1
    with np.errstate(over="ignore", under="ignore"):
        codes = np.clip(np.rint(rows / scale[:, None]), -127, 127).astype(np.int8)
        return codes, scale, np.sqrt(((rows - codes * scale[:, None]) ** 2).sum(axis=1))


def tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows."""
    out = np.zeros((len(a), len(b)))
    for start in range(0, a.shape[1], _EXACT_DIMS):
        part = slice(start, start + _EXACT_DIMS)
        out += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return out


def away(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows from a query; where squares would leave the range of doubles, of scaled differences."""
    with np.errstate(over="ignore", under="ignore"):
        apart = rows - query
        out = np.sqrt((apart**2).sum(axis=1))
        odd = np.flatnonzero(~((out > 1e-140) & (out < 1e150)))
        if len(odd):
            half = rows[odd] / 2 - query / 2
            most = np.abs(half).max(axis=1)
            most[most == 0] = 1
            out[odd] = np.sqrt(((half / most[:, None]) ** 2).sum(axis=1)) * most * 2
    return out


def best_by_tiles(k: int, q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k nearest rows. The distance of two rows differs from that of their codes by the two errors at most;
    rows whose lower bound exceeds the k-th smallest upper bound can't be among the k nearest, the others are measured."""
    q_codes, q_scale, q_error = quantise(queries)
    codes, scale, error = quantise(rows)
    with np.errstate(over="ignore", under="ignore"):
        q_norm = (q_codes.astype(float) ** 2).sum(axis=1) * q_scale**2
        norm = (codes.astype(float) ** 2).sum(axis=1) * scale**2
    for start in range(0, len(queries), 256):
        part = slice(start, start + 256)
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            size = q_norm[part, None] + norm
            about = np.sqrt(np.maximum(0, size - 2 * q_scale[part, None] * scale * tile(q_codes[part], codes)))
            room = q_error[part, None] + error + _SLACK * np.sqrt(size)
            # where numbers leave the range of doubles nothing is known, and rows are measured
            upper, lower = np.nan_to_num(about + room, nan=np.inf, posinf=np.inf), np.nan_to_num(about - room, nan=-np.inf, posinf=-np.inf)
        for i in range(len(about)):
            at = start + i
            others = ids != q_ids[at]
            if others.sum() > k:
                limit = np.partition(upper[i][others], k - 1)[k - 1]
                others &= lower[i] <= limit
            left = np.flatnonzero(others)
            nearest = heapq.nsmallest(k, zip(away(rows[left], queries[at]).tolist(), left.tolist(), strict=True))
            yield at, np.array([j for _, j in nearest], np.int64), np.array([d for d, _ in nearest], np.float64)


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of smallest Euclidean distance to each query; nothing is missed.

    Queries are the rows whose vec_id is divisible by `every`. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do rows without vec_id. An id is one vector: rows that share a query's vec_id
    are its own, and of rows with one vec_id the greatest vector counts. Vectors of different lengths aren't compared.
    Ties go to the smaller vec_id; extra columns are ignored; an empty table gives an empty result.
    """
    rows = usable(vectors, zero_too=False).groupBy("vec_id").agg(F.max("vec").alias("vec")).withColumn("dim", F.size("vec"))

    def best(*args: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return best_by_tiles(k, *args)

    return search(rows, F.col("vec_id") % every == 0, k, best, "double", ascending=True)
