"""TF-IDF recall: how much of what a conversation's suffix talks about the kept turns hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.coverage import harmonic

# What counts as a term.
PATH_TERM, WORD_TERM = r"(?:[./~])?(?:/[\w.\-]+){2,}", r"[a-zA-Z_][a-zA-Z0-9_./\-]{3,}"
# End of fixed values.


def vocabulary(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, tf: paths and words in lower case."""
    text = F.coalesce(F.col("text"), F.lit(""))
    terms = F.concat(F.regexp_extract_all(text, F.lit("(?U)" + PATH_TERM), F.lit(0)), F.regexp_extract_all(text, F.lit(WORD_TERM), F.lit(0)))
    return turns.select(*keys, F.explode(F.transform(terms, F.lower)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def relevance(prefix: DataFrame, suffix: DataFrame) -> DataFrame:
    """conv_id, turn_index, relevance: of each prefix system turn, the sum of tf * ln(1 + n / df) * tf in the suffix."""
    system = prefix.where("kind = 'system'")
    own = vocabulary(system, ["conv_id", "turn_index"])
    df = own.groupBy(F.col("conv_id").alias("_dc"), F.col("term").alias("_dt")).agg(F.count("*").alias("df"))
    n = system.groupBy(F.col("conv_id").alias("_nc")).agg(F.count("*").alias("n"))
    later = vocabulary(suffix, ["conv_id"]).select(F.col("conv_id").alias("_sc"), F.col("term").alias("_st"), F.col("tf").alias("suffix_tf"))
    rows = own.join(later, (F.col("conv_id") == F.col("_sc")) & (F.col("term") == F.col("_st")))
    rows = rows.join(df, (F.col("conv_id") == F.col("_dc")) & (F.col("term") == F.col("_dt"))).join(n, F.col("conv_id") == F.col("_nc"))
    sums = rows.groupBy(F.col("conv_id").alias("_c"), F.col("turn_index").alias("_t")).agg(F.sum(F.col("tf") * F.log(1 + F.col("n") / F.col("df")) * F.col("suffix_tf")).alias("_r"))
    return system.join(sums, (F.col("conv_id") == F.col("_c")) & (F.col("turn_index") == F.col("_t")), "left").select("conv_id", "turn_index", F.coalesce("_r", F.lit(0.0)).alias("relevance"))


def recall(relevances: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, recall: the share of relevance in kept turns; 1 where there is none."""
    flags = kept.where("kept").select(F.col("conv_id").alias("_c"), F.col("turn_index").alias("_t"))
    rows = relevances.join(flags, (F.col("conv_id") == F.col("_c")) & (F.col("turn_index") == F.col("_t")), "left")
    total, held = F.sum("relevance"), F.sum(F.when(F.col("_c").isNotNull(), F.col("relevance")).otherwise(0.0))
    return rows.groupBy("conv_id").agg(F.when(total > 0, held / total).otherwise(1.0).alias("recall"))


def evaluated(relevances: DataFrame, selected: DataFrame) -> DataFrame:
    """conv_id, recall, compression, f1, kept_tokens, total_tokens, scored_count, kept_scored of a selection."""
    sums = selected.groupBy(F.col("conv_id").alias("_s")).agg(
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("tokens"))), F.lit(0)).cast("long").alias("kept_tokens"), F.sum("tokens").cast("long").alias("total_tokens"),
        F.count_if(F.col("score").isNotNull()).alias("scored_count"), F.count_if(F.col("kept") & F.col("score").isNotNull()).alias("kept_scored"),
    )
    rows = recall(relevances, selected).join(sums, F.col("conv_id") == F.col("_s"))
    rows = rows.withColumn("compression", F.when(F.col("total_tokens") > 0, F.col("kept_tokens") / F.col("total_tokens")).otherwise(0.0))
    return rows.select("conv_id", "recall", "compression", harmonic(F.col("recall"), 1 - F.col("compression")).alias("f1"), "kept_tokens", "total_tokens", "scored_count", "kept_scored")
