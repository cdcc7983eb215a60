"""How well kept turns cover the entities that the rest of a conversation needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.entities import explode_entities, weight
from winnow.operators.turns import spread


def joined_text(turns: DataFrame) -> DataFrame:
    """conv_id, text: the turns' texts in order, joined by line feeds, as entities may reach across the joint."""
    rows = F.array_sort(F.collect_list(F.struct("turn_index", "text")))
    return spread(turns, "conv_id").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def covered(suffix: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, etype, value, hit: the entities of the suffix's system turns, and whether the kept turns hold them."""
    return covered_of(explode_entities(joined_text(suffix.where("kind = 'system'")), ["conv_id"]), kept)


def covered_of(needed: DataFrame, kept: DataFrame) -> DataFrame:
    """The same of entities (conv_id, etype, value) that are at hand."""
    held = explode_entities(joined_text(kept), ["conv_id"]).select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "etype", "value")], F.lit(True).alias("_hit"))
    same = (F.col("conv_id") == F.col("_conv_id")) & (F.col("etype") == F.col("_etype")) & (F.col("value") == F.col("_value"))
    return needed.join(held, same, "left").select("conv_id", "etype", "value", F.coalesce("_hit", F.lit(False)).alias("hit"))


def type_breakdown(hits: DataFrame) -> DataFrame:
    """conv_id, etype, covered, total, coverage, weight of the types that occur."""
    out = hits.groupBy("conv_id", "etype").agg(F.count_if("hit").alias("covered"), F.count("*").alias("total"))
    return out.select("conv_id", "etype", "covered", "total", (F.col("covered") / F.col("total")).alias("coverage"), weight(F.col("etype")).alias("weight"))


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def coverage(conversations: DataFrame, types: DataFrame) -> DataFrame:
    """conversations (conv_id, total_tokens, kept_tokens) with coverage, weighted_coverage, compression and f1; a suffix
    without entities counts as covered."""
    sums = types.groupBy(F.col("conv_id").alias("_c")).agg(
        F.sum("covered").alias("covered_count"), F.sum("total").alias("suffix_entity_count"),
        F.sum(F.col("weight") * F.col("covered")).alias("_wc"), F.sum(F.col("weight") * F.col("total")).alias("_wt"),
    )
    rows = conversations.join(sums, F.col("conv_id") == F.col("_c"), "left").drop("_c")
    rows = rows.withColumn("coverage", F.coalesce(F.col("covered_count") / F.col("suffix_entity_count"), F.lit(1.0)))
    rows = rows.withColumn("weighted_coverage", F.coalesce(F.col("_wc") / F.col("_wt"), F.lit(1.0)))
    rows = rows.withColumn("compression", F.when(F.col("total_tokens") > 0, F.col("kept_tokens") / F.col("total_tokens")).otherwise(0.0))
    rows = rows.withColumn("f1", harmonic(F.col("weighted_coverage"), 1 - F.col("compression")))
    return rows.withColumn("covered_count", F.coalesce("covered_count", F.lit(0))).withColumn("suffix_entity_count", F.coalesce("suffix_entity_count", F.lit(0))).drop("_wc", "_wt")


def report(results: DataFrame, metrics: list[str], methods: list[str]) -> DataFrame:
    """Metrics by rows, methods by columns: the mean of each."""
    pairs = F.stack(F.lit(len(metrics)), *[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]).alias("metric", "value")
    return results.select("method", pairs).groupBy("metric").pivot("method", methods).agg(F.avg("value"))
