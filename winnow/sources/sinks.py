"""Sinks: compacted sessions, summaries, score tables and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits and marks of the rendered forms.
SUMMARY_LIMIT, PREVIEW, DETAIL_PREVIEW, DETAIL_DROPPED = 4000, 120, 80, 20
CUT_MARK, RULE = "\n[... truncated]", "\n\n---\n\n"
# End of fixed values.


def session_lines(kept: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """conv_id, pos, value: the kept turns' lines word for word, after the session's header line, if there is one."""
    body = kept.select("conv_id", "turn_index", F.posexplode("lines").alias("at", "value"))
    body = body.select("conv_id", F.struct(F.col("turn_index"), F.col("at").cast("long").alias("at")).alias("pos"), "value")
    if headers is None:
        return body
    first = F.struct(F.lit(-1).cast("long").alias("turn_index"), F.lit(0).cast("long").alias("at"))
    return headers.select("conv_id", first.alias("pos"), F.col("raw").alias("value")).unionByName(body)


def write_sessions(kept: DataFrame, folder: str, headers: DataFrame | None = None) -> None:
    """One ordered text file for each conversation below folder/conv_id=...; overwrites what stood there."""
    rows = session_lines(kept, headers).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    rows.select("conv_id", "value").write.mode("overwrite").partitionBy("conv_id").text(folder)


def summary(kept: DataFrame) -> DataFrame:
    """conv_id, summary: the kept turns' texts under their headings; empty ones are left out, long ones cut."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    cut = F.when(F.length(text) > SUMMARY_LIMIT, F.concat(F.left(text, F.lit(SUMMARY_LIMIT)), F.lit(CUT_MARK))).otherwise(text)
    who = F.when(F.col("kind") == "user", "User").otherwise("Assistant")
    part = F.concat(F.lit("["), who, F.lit(" (turn "), F.col("turn_index").cast("string"), F.lit(")]:\n"), cut)
    rows = kept.where(F.length(text) > 0).select("conv_id", "turn_index", part.alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("turn_index", "part")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), RULE).alias("summary"))


def score_rows(selected: DataFrame) -> DataFrame:
    """conv_id, turn_index, score (four places), tokens, kept, preview of every scored turn."""
    preview = F.replace(F.left("text", F.lit(PREVIEW)), F.lit("\n"), F.lit(" "))
    return selected.where("score is not null").select("conv_id", "turn_index", F.format_string("%.4f", "score").alias("score"), "tokens", "kept", preview.alias("preview"))


def write_scores(selected: DataFrame, path: str) -> None:
    score_rows(selected).sortWithinPartitions("conv_id", "turn_index").write.mode("overwrite").option("header", True).csv(path)


def stats(selected: DataFrame) -> DataFrame:
    """Counts and tokens of each conversation. reported_kept_tokens leaves the forced last turn out, as the published
    figures do; kept_tokens does not."""
    total = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0)).cast("long").alias(name)
    kept, tier = F.col("kept"), F.col("tier")
    out = selected.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(kept).alias("kept_turns"), F.sum("tokens").cast("long").alias("total_tokens"),
        total(tier == "user", "user_tokens"), total(tier == "short", "short_tokens"), total(kept, "kept_tokens"),
        total(kept & ~((F.col("reason") == "last") & (tier == "long")), "reported_kept_tokens"),
    )
    return out.withColumn("compression", F.when(F.col("total_tokens") > 0, F.col("kept_tokens") / F.col("total_tokens")).otherwise(0.0))


def score_detail(selected: DataFrame) -> DataFrame:
    """Kept scored turns by score, and the 20 best dropped ones: conv_id, kept, rank, turn_index, score, preview."""
    order = Window.partitionBy("conv_id", "kept").orderBy(F.col("score").desc(), "turn_index")
    rows = selected.where("score is not null").withColumn("rank", F.row_number().over(order))
    preview = F.replace(F.left("text", F.lit(DETAIL_PREVIEW)), F.lit("\n"), F.lit(" "))
    return rows.where(F.col("kept") | (F.col("rank") <= DETAIL_DROPPED)).select("conv_id", "kept", "rank", "turn_index", "score", preview.alias("preview"))
