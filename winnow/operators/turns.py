"""Turns: runs of records, in the order of a session's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as the session shuffles to. Texts are long for their compressed size, by which
    Spark would put many of these tasks together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def islands(records: DataFrame, order: str, new: Column) -> DataFrame:
    """Adds turn_index, from 0, which grows by one where `new` is true; the first record of a conversation is new."""
    line = Window.partitionBy("conv_id").orderBy(order)
    starts = (F.col(order) == F.min(order).over(Window.partitionBy("conv_id"))) | F.coalesce(new, F.lit(False))
    return records.withColumn("_new", starts.cast("int")).withColumn("turn_index", (F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_new")


def group_blocks(records: DataFrame) -> DataFrame:
    """records (conv_id, line_no, is_user): each user record is a turn, each run of others one system turn."""
    records = spread(records, "conv_id")
    before = F.lag("is_user").over(Window.partitionBy("conv_id").orderBy("line_no"))
    return islands(records, "line_no", F.col("is_user") | before).withColumn("kind", F.when(F.col("is_user"), "user").otherwise("system"))


def group_rollout(records: DataFrame) -> DataFrame:
    """records (conv_id, line_no, class in compacted, context, user, system; others are dropped) with turns.

    A compacted record is a turn; a context record starts a user turn; a user record joins a user turn that stands right
    before it; system records run on.
    """
    kept = spread(records.where(F.col("class").isin("compacted", "context", "user", "system")), "conv_id")
    before = F.lag("class").over(Window.partitionBy("conv_id").orderBy("line_no"))
    c = F.col("class")
    new = c.isin("compacted", "context") | ((c == "user") & ~before.isin("context", "user")) | ((c == "system") & (before != "system"))
    return islands(kept, "line_no", new).withColumn("kind", F.when(c.isin("context", "user"), "user").otherwise("system"))


def joined(records: DataFrame) -> DataFrame:
    """conv_id, turn_index, kind, lines, text, n_records: the records of each turn in order of lines."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text", "raw")))
    return records.groupBy("conv_id", "turn_index", "kind").agg(rows.alias("_r")).select(
        "conv_id", "turn_index", "kind",
        F.transform("_r", lambda r: r["raw"]).alias("lines"),
        F.array_join(F.transform("_r", lambda r: r["text"]), "\n").alias("text"),
        F.size("_r").cast("long").alias("n_records"),
    )


def from_flat(conversations: DataFrame, skip_system: bool = True) -> DataFrame:
    """Records of a flat table (conv_id, turn, role, text): user rows are users, others system; `system` rows are skipped."""
    rows = conversations.where("role <> 'system'") if skip_system else conversations
    return rows.select("conv_id", F.col("turn").alias("line_no"), (F.col("role") == "user").alias("is_user"), "text", F.to_json(F.struct("role", "text")).alias("raw"))
