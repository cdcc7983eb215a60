"""Query and candidate blocks for exhaustive searches: what the two vector searches share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import blocks_for

#: Rows in a block of candidates and of queries: what one task holds of either at a time.
CANDIDATES, QUERIES = 2048, 1024


def matrix(columns: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(columns), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, zero_too: bool) -> DataFrame:
    """(vec_id, vec, dim) of the rows that take part: no null, empty or non-finite vector, and no zero one unless zero_too."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    kept = kept.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & ~bad)
    if not zero_too:
        kept = kept.where(F.exists("vec", lambda x: x != 0))
    return kept.withColumn("dim", F.size("vec"))


def search(
    rows: DataFrame,
    is_query: Column,
    k: int,
    best: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    score_type: str,
    ascending: bool,
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
) -> DataFrame:
    """For each query row the k best of all rows, by `best` on each pair of blocks and a merge of the blocks' own k.

    best(query_ids, query_vectors, ids, vectors) yields (row of the query, candidates' rows, scores), at least the
    block's k best. Blocks are dealt by a hash of the id; each candidate block is sent once for each block of queries, so
    that a task holds one block of either, whatever their number. Rows of different lengths meet only their like.
    """
    spark_rows = rows.withColumn("_query", is_query)
    counts = spark_rows.agg(F.count("*").alias("n"), F.count_if("_query").alias("q")).first()
    n_c, n_q = blocks_for(counts.n, candidates), blocks_for(counts.q, queries)
    own = F.pmod(F.xxhash64("vec_id"), F.lit(n_c)).cast("int")
    of_query = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_q)).cast("int")
    packed_schema = "block int, other int, dim int, asked boolean, ids binary, vecs binary"

    def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vec_id", kind="stable")
        vecs = np.ascontiguousarray(np.stack(p["vec"].to_list()), np.float64)
        return pd.DataFrame({"block": [key[0]], "other": [0], "dim": [key[1]], "asked": [key[2]], "ids": [p["vec_id"].to_numpy(np.int64).tobytes()], "vecs": [vecs.tobytes()]})

    def packed(df: DataFrame, block: Column, asked: bool) -> DataFrame:
        return df.select(block.alias("block"), "dim", F.lit(asked).alias("asked"), "vec_id", "vec").groupBy("block", "dim", "asked").applyInPandas(pack, packed_schema)

    left = packed(spark_rows, own, False).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    right = packed(spark_rows.where("_query"), of_query, True)
    right = right.withColumn("other", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    out_schema = f"query_id long, vec_id long, score {score_type}"
    out_type = pa.int64() if score_type == "long" else pa.float64()

    def run(key: tuple, t: pa.Table) -> pa.Table:
        asked = [r for r in t.to_pylist() if r["asked"]]
        there = [r for r in t.to_pylist() if not r["asked"]]
        found: tuple[list, list, list] = ([], [], [])
        for q in asked:
            q_ids, q_vecs = np.frombuffer(q["ids"], np.int64), matrix([q["vecs"]], q["dim"])
            for c in there:
                ids, vecs = np.frombuffer(c["ids"], np.int64), matrix([c["vecs"]], c["dim"])
                for i, rows_of, scores in best(q_ids, q_vecs, ids, vecs):
                    found[0].append(np.full(len(rows_of), q_ids[i]))
                    found[1].append(ids[rows_of])
                    found[2].append(scores)
        joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]
        return pa.table([pa.array(joined[0], pa.int64()), pa.array(joined[1], pa.int64()), pa.array(joined[2], out_type)], names=["query_id", "vec_id", "score"])

    partial = left.unionByName(right).groupBy("block", "other", "dim").applyInArrow(run, out_schema)
    # a few rows for each block and query: k of each block at most, besides ties of equal ids
    order = Window.partitionBy("query_id").orderBy(F.col("score").asc() if ascending else F.col("score").desc(), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
