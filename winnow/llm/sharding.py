"""Sharding of indivisible groups into shards of near-equal bytes by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import blocks_for, materialise, running

#: Partial partitions that one task combines.
PER_BLOCK = 16_000


def difference(parts: np.ndarray) -> np.ndarray:
    """Combine partial partitions (a row of k sums each) into one; returns, for each row and column, its final bin.

    The two of the largest spread are added, the largest sum of one to the smallest of the other, until one is left.
    """
    n, k = parts.shape
    sums = [np.sort(p) for p in parts]
    at = [np.argsort(p, kind="stable") for p in parts]  # at[i][j]: the column of i's own partition that stands at j
    merged: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(total, kind="stable")
        sums.append(total[order])
        merged.append((a, b, order))
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
    final: list[np.ndarray | None] = [None] * (n + len(merged))
    final[-1] = np.arange(k)
    for i in range(len(merged) - 1, -1, -1):
        a, b, order = merged[i]
        back = np.empty(k, np.int64)
        back[order] = final[n + i]
        final[a], final[b] = back, back[::-1]
        final[n + i] = None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i][at[i]] = final[i]
    return out


def balanced(groups: DataFrame, shards: int, per_block: int = PER_BLOCK) -> DataFrame:
    """groups (group, size) -> (group, shard).

    Blocks of groups are differenced each by itself to one partial partition of `shards` sums; blocks of those are
    differenced in turn, level by level, until one partition is left. No task holds more than per_block of them.
    """
    spark = groups.sparkSession
    count = groups.count()
    level = blocks_for(count, per_block)
    block = F.pmod(F.xxhash64("group"), F.lit(level)).cast("long")

    def first(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["size", "group"], ascending=[False, True])
        parts = np.zeros((len(p), shards), np.int64)
        parts[:, -1] = p["size"].to_numpy(np.int64)
        return pd.DataFrame({"group": p["group"], "size": p["size"], "_block": key[0], "_bin": difference(parts)[:, -1]})

    placed = materialise(groups.select("group", "size", block.alias("_block")).groupBy("_block").applyInPandas(first, "group binary, size long, _block long, _bin long"), "kk")
    parts = placed.groupBy("_block", "_bin").agg(F.sum("size").alias("size"))
    while level > 1:
        above = blocks_for(level, per_block // shards)
        parent = F.pmod("_block", F.lit(above)).cast("long")

        def next_level(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            wide = p.pivot_table(index="_block", columns="_bin", values="size", aggfunc="sum", fill_value=0).reindex(columns=range(shards), fill_value=0).sort_index()
            found = difference(wide.to_numpy(np.int64))
            rows, columns = np.indices(found.shape)
            return pd.DataFrame({"_from": wide.index.to_numpy()[rows.ravel()], "_bin": columns.ravel(), "size": wide.to_numpy().ravel(), "_to": key[0], "_new": found.ravel()})

        moved = materialise(parts.withColumn("_parent", parent).groupBy("_parent").applyInPandas(next_level, "_from long, _bin long, size long, _to long, _new long"), "kk")
        names = moved.select(F.col("_from").alias("_block"), "_bin", "_to", "_new")
        placed = placed.join(names, ["_block", "_bin"]).select("group", "size", F.col("_to").alias("_block"), F.col("_new").alias("_bin"))
        parts = moved.groupBy(F.col("_to").alias("_block"), F.col("_new").alias("_bin")).agg(F.sum("size").alias("size"))
        level = above
    return placed.select("group", F.col("_bin").cast("int").alias("shard"))


def sharded(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document, under the law `bytes`.

    Equal texts are one group and share a shard; a null text counts as an empty one. A group larger than a shard's share
    stays whole, and its shard is then the largest. Repeated rows and null ids are kept; an empty table gives an empty
    result; extra columns are ignored. Slots number a shard's rows without gaps, in order of a hash of doc_id.
    """
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = materialise(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 8).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.unhex(F.sha2(raw, 256)).alias("group"),
        ),
        "sizes",
    )
    shard = balanced(rows.groupBy("group").agg(F.sum("size").alias("size")), shards)
    placed = rows.join(shard.withColumnRenamed("group", "_group"), F.col("group") == F.col("_group")).drop("group", "_group")
    order = F.xxhash64("doc_id")
    found = running(placed, ["shard"], F.shiftright(order, 54), [order, F.col("doc_id"), F.col("text_crc32")], F.lit(1).cast("long"), "_n")
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
