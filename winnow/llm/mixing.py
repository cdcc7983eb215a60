"""Mixing of sources to target weights by weighted fair queueing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import WORD, materialise, running

#: The weights that sources take in turn.
WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, budget: float, most: float) -> DataFrame:
    """sources (source, source_size), one row each, with weight and target.

    Sources by code point, null last, take WEIGHTS in turn and share budget * (sum of sizes). A target stops at most times
    its source's size; what is above is shared out anew by weight until none is above: with sources in order of
    size / weight, those before the first whose limit exceeds its share of the rest stand at their limit.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (nth % len(WEIGHTS) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_share", rest / left)
    free = F.min(F.when(F.col("_limit") > F.col("_share") * F.col("weight"), F.struct(F.col("_limit") / F.col("weight"), F.col("_share")))).over(whole)
    share = F.coalesce(free["_share"], F.lit(float("inf")))
    return rows.select("source", "source_size", "weight", F.least("_limit", share * F.col("weight")).alias("target"))


def _placed(documents: DataFrame, budget: float, most: int) -> tuple[DataFrame, float, int]:
    """(documents with the targets of their sources and _sum, the words of their source up to and including them; the
    budget in words; the power of two of the pieces that a range of hashes or of finishes is cut into)."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = materialise(rows.withColumn("_hash", F.xxhash64("doc_id", "source", "size")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialise(targets(sources, budget, most).select(F.col("source").alias("_source"), "source_size", "target"), "targets")
    total = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * budget
    bits = 8 + (rows.count() // 1_000_000).bit_length()
    summed = running(rows, ["source"], F.shiftright("_hash", 64 - bits), [F.col("_hash"), F.col("doc_id"), F.col("size")], F.col("size"), "_sum")
    placed = summed.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return materialise(placed, "placed"), total, bits


def _stream(placed: DataFrame, total: float, bits: int, most: int) -> DataFrame:
    again = placed.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    queue = again.withColumn("finish", (F.col("_sum") + F.col("pass") * F.col("source_size")) / F.col("target"))
    # targets end at 1; far beyond, where little is left to take, ranges widen
    f, pieces = F.col("finish"), F.lit(1 << bits)
    ranges = F.when(f < 4, F.floor(f * pieces)).otherwise(F.floor((F.log2(f) + 2) * pieces)).cast("long")
    order = [f, *[F.col(c) for c in ("_hash", "doc_id", "pass", "source", "size")]]
    found = running(queue.withColumn("_all", F.lit(0)), ["_all"], ranges, order, F.col("size"), "_taken")
    return found.withColumn("taken", F.col("_taken") <= F.lit(total))


def mixed(documents: DataFrame, budget: float = 1.5, most: int = 2) -> DataFrame:
    """The mix as a stream, in order of finish: doc_id, source, size, pass, finish, a row for each time a document is taken.

    Each source's documents, shuffled by a hash, pass `most` times; a document's finish is the words of its source up to
    and including it, divided by the source's target. All are cut into ranges of finish, ordered within them, and taken
    up to the budget. Only sums leave the ranges: no source, and not the whole queue, is sorted in one task.
    """
    found = _stream(*_placed(documents, budget, most), most).where("taken")
    return found.select("doc_id", "source", "size", "pass", "finish").orderBy("finish", "source", "doc_id", "pass")


def mix(documents: DataFrame, budget: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document.

    size counts words; a null or empty text has none and is never taken. A null source is a source like others. Repeated
    rows, and rows without doc_id, are documents of their own. An empty table gives an empty result; extra columns are
    ignored. Equal finishes go by the hash of (doc_id, source, size), then doc_id and pass, so that reruns agree.
    """
    placed, total, bits = _placed(documents, budget, most)
    # equal rows with words differ by where they stand in their source
    own = ["doc_id", "source", "size", "source_size", "target"]
    taken = F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken")
    some = _stream(placed, total, bits, most).groupBy(*own, "_sum").agg(taken).select(*own, "taken")
    none = placed.where((F.col("size") == 0) | (F.col("target") == 0)).select(*own, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)
