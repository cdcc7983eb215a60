"""Chat formatting of reply trees, with DataFrame functions only.

Root-to-leaf paths are enumerated by self-joins that double the reach of a jump table each round, so that a path of d
messages takes log2(d) rounds; branches are ranked by score; each chosen path becomes one formatted conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import materialise

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""`<|` becomes `<\|`, and each `<\..\|` gets one backslash more: no control string is left, and nothing is lost."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def as_chain(conversations: DataFrame) -> DataFrame:
    """Rows of linear conversations as a tree: each answers the row before it in its conversation's order of turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.withColumn("msg_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return placed.select("conv_id", "msg_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, msg_id, up, score): each leaf with itself and all its ancestors, `up` steps above it."""
    nodes = materialise(messages.select("conv_id", "msg_id", F.when(F.col("parent_id") < F.col("msg_id"), F.col("parent_id")).alias("parent_id"), "score"), "nodes")

    def same(a: DataFrame, left: str, b: DataFrame, right: str) -> Column:
        return a["conv_id"].eqNullSafe(b["_conv"]) & (a[left] == b[right])

    ids = nodes.select(F.col("conv_id").alias("_conv"), F.col("msg_id").alias("_id"))
    jump = nodes.join(ids, same(nodes, "parent_id", ids, "_id")).select("conv_id", "msg_id", F.col("parent_id").alias("to"))
    jump = materialise(jump, "jump")
    parents = jump.select(F.col("conv_id").alias("_conv"), F.col("to").alias("_id")).distinct()
    leaves = nodes.join(parents, same(nodes, "msg_id", parents, "_id"), "left_anti")
    found = leaves.select("conv_id", F.col("msg_id").alias("leaf"), "msg_id", F.lit(0).cast("long").alias("up"))
    reach = 1
    while not jump.isEmpty():
        step = jump.select(F.col("conv_id").alias("_conv"), F.col("msg_id").alias("_from"), F.col("to").alias("_to"))
        more = found.join(step, same(found, "msg_id", step, "_from")).select("conv_id", "leaf", F.col("_to").alias("msg_id"), (F.col("up") + reach).alias("up"))
        found = materialise(found.unionByName(more), "paths")
        jump = materialise(jump.join(step, same(jump, "to", step, "_from")).select("conv_id", "msg_id", F.col("_to").alias("to")), "jump")
        reach *= 2
    scores = nodes.select(F.col("conv_id").alias("_conv"), F.col("msg_id").alias("_id"), "score")
    return found.join(scores, same(found, "msg_id", scores, "_id")).drop("_conv", "_id")


def formatted(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv_id, leaf, rank, text, loss): the best branches of each tree as text; loss: array of (start, length) in code
    points, the spans of the assistant's texts.

    messages: conv_id, msg_id (unique in a tree), parent_id, role, text, score. A parent that is missing, null or not
    smaller than msg_id makes a root. A path's score is the mean of its messages', nulls aside; ties go to the smaller
    leaf, nulls last. Null roles and texts are empty; a null conv_id is a tree like others. An empty table gives an empty result.
    """
    steps = paths(messages)
    totals = steps.groupBy("conv_id", "leaf").agg(F.avg("score").alias("_score"))
    order = Window.partitionBy("conv_id").orderBy(F.col("_score").desc_nulls_last(), "leaf")
    chosen = totals.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= branches)
    chosen = chosen.select(F.col("conv_id").alias("_conv"), F.col("leaf").alias("_leaf"), "rank")
    kept = steps.join(chosen, steps["conv_id"].eqNullSafe(chosen["_conv"]) & (steps["leaf"] == chosen["_leaf"])).select("conv_id", "leaf", "rank", "msg_id", "up")
    texts = messages.select(F.col("conv_id").alias("_conv"), F.col("msg_id").alias("_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    rows = kept.join(texts, kept["conv_id"].eqNullSafe(texts["_conv"]) & (kept["msg_id"] == texts["_id"]))
    rows = rows.select("conv_id", "leaf", "rank", "up", "role", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("body")).alias("body"))
    tail = END + "\n"
    size = F.length("head") + F.length("body") + len(tail)
    before = Window.partitionBy("conv_id", "leaf", "rank").orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(at.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    placed = rows.select("conv_id", "leaf", "rank", "up", F.concat("head", "body", F.lit(tail)).alias("part"), span.alias("span"))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "part", "span")))
    return placed.groupBy("conv_id", "leaf", "rank").agg(turns.alias("turns")).select(
        "conv_id", "leaf", "rank",
        F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("text"),
        F.transform(F.filter("turns", lambda t: t["span"].isNotNull()), lambda t: t["span"]).alias("loss"),
    )


def read_back(texts: DataFrame) -> DataFrame:
    """Parse formatted text: adds turns (array of role, text) and loss_text, all unescaped text under the loss mask."""
    pieces = F.split("text", r"<\|im_start\|>")
    parts = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END + "\n"))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    under = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return texts.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(under, ""))
