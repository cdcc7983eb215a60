"""Greedy first-fit selection of turns under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: what being late adds to a score at most.
RECENCY = 0.15
# End of fixed values.


def select_turns(turns: DataFrame, scores: DataFrame, budget: int) -> DataFrame:
    """turns (conv_id, turn_index, kind, tokens, tier, ...) with score, adjusted, kept and reason.

    User, short and the last system turn are kept, even past the budget. Of the others, by score plus recency, each that
    still fits is kept and each that doesn't is passed over. A conversation's scored turns make one array: numbers only.
    """
    whole = Window.partitionBy("conv_id")
    marked = turns.withColumn("_last", F.max(F.when(F.col("kind") == "system", F.col("turn_index"))).over(whole)).withColumn("_n", F.count("*").over(whole))
    known = scores.select(F.col("conv_id").alias("_c"), F.col("turn_index").alias("_t"), "score")
    rows = marked.join(known, (F.col("conv_id") == F.col("_c")) & (F.col("turn_index") == F.col("_t")), "left").drop("_c", "_t")
    forced = F.col("tier").isin("user", "short") | F.coalesce(F.col("turn_index") == F.col("_last"), F.lit(False))
    rows = rows.withColumn("_forced", forced).withColumn("adjusted", F.round(F.col("score") + RECENCY * F.col("turn_index") / F.col("_n"), 9))
    open_ = F.col("score").isNotNull() & ~F.col("_forced")
    items = F.array_sort(F.collect_list(F.when(open_, F.struct((-F.col("adjusted")).alias("a"), F.col("turn_index").alias("i"), F.col("tokens").alias("t")))))
    left = (F.lit(budget) - F.coalesce(F.sum(F.when(F.col("_forced"), F.col("tokens"))), F.lit(0))).cast("long")
    per = rows.groupBy("conv_id").agg(items.alias("_items"), left.alias("_left"))

    def step(acc, x):
        fits = x["t"] <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - x["t"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["kept"], F.array(x["i"]))).otherwise(acc["kept"]).alias("kept"))

    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<bigint>").alias("kept"))
    chosen = per.select(F.col("conv_id").alias("_c"), F.aggregate("_items", start, step)["kept"].alias("_kept"))
    out = rows.join(chosen, F.col("conv_id") == F.col("_c"))
    kept = F.col("_forced") | F.array_contains("_kept", F.col("turn_index"))
    reason = F.when(F.col("tier") == "user", "user").when(F.col("tier") == "short", "short").when(F.col("_forced"), "last").when(kept, "fits").when(F.col("score").isNull(), "unscored").otherwise("dropped")
    return out.withColumn("kept", kept).withColumn("reason", reason).drop("_c", "_last", "_n", "_forced", "_kept")
