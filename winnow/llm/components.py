"""Connected components of a graph by alternating large and small stars; no step gathers a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from winnow.llm.common import discard, materialise


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and the sum of their hashes."""
    seen = Observation()
    out = materialise(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
    return out, (seen.get["n"], seen.get["h"])


def _least(edges: DataFrame) -> DataFrame:
    """_u, _m: the smallest end of each node's edges. Dealt anew, so that a join with it can be split where a hub is."""
    return edges.groupBy(F.col("a").alias("_u")).agg(F.min("b").alias("_m")).repartition(F.xxhash64("_u"))


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b: long; loops and repeats allowed, null ends are no edge) -> (node, root), the smallest node reachable.

    Only nodes that have an edge to another come back. Every round at least halves what lies between a node and its root
    in practice; a hub's edges meet their minimum in a join, which Spark splits where it is skewed.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = _written(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), F.col("a") == F.col("_u")).where("b > a").select(F.col("b").alias("a"), F.least("_m", "a").alias("b")).distinct()
        small = large.join(_least(large), F.col("a") == F.col("_u")).where("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        roots = large.groupBy("a").agg(F.min("b").alias("b"))
        after, state = _written(small.unionByName(roots).distinct())
        discard(now)
        now = after
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
