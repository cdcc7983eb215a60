"""Text of session records, in the two formats, and scalar helpers over turns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Limits of rendered parts, in characters, and blocks whose text is shown.
INPUT_LIMIT, TEXT_INPUT_LIMIT, QUERY_LIMIT = 500, 1000, 4000
PLAIN_BLOCKS = ("text", "output_text", "input_text")
# End of fixed values.


def _inputs(given: object) -> list[str]:
    """What a tool was given: a line for each name, values as Python prints them."""
    if isinstance(given, str):
        return [given[:TEXT_INPUT_LIMIT]]
    shown = {k: str(v) for k, v in given.items()} if isinstance(given, dict) else {}
    return [f"  {k}: {v[:INPUT_LIMIT]}{'...' * (len(v) > INPUT_LIMIT)}" for k, v in shown.items()]


#: The lines that a block of a message gives, by its type; other types give none.
_SHOWN = {
    "text": lambda b: [str(b.get("text", ""))],
    "thinking": lambda b: [str(b.get("thinking", ""))],
    "tool_use": lambda b: [f"[tool_use: {b.get('name', '')}]", *_inputs(b.get("input", {}))],
    "tool_result": lambda b: _results(b.get("content", "")),
}


def _results(content: object) -> list[str]:
    if isinstance(content, str):
        return [content]
    blocks = content if isinstance(content, list) else []
    return [str(b.get("text", "")) for b in blocks if isinstance(b, dict) and b.get("type") == "text"]


def _message(raw: str | None) -> str:
    try:
        content = json.loads(raw or "")["message"]["content"]
    except (ValueError, KeyError, TypeError):
        return ""
    if isinstance(content, str):
        return content
    blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
    return "\n".join(line for b in blocks for line in _SHOWN.get(str(b.get("type")), lambda _: [])(b))


@F.pandas_udf(StringType())
def blocks_text(raw: pd.Series) -> pd.Series:
    """Text of a record of the block format. Values of tool inputs are rendered as Python prints them, hence Arrow."""
    return raw.map(_message)


def _cut_to(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def rollout_text(raw: Column | str) -> Column:
    """Text of a record of the rollout format, or null if it has none: a column expression over the parsed record."""
    record = F.try_parse_json(raw)
    body = F.coalesce(F.try_variant_get(record, "$.payload", "variant"), record)

    def said(v: Column, path: str) -> Column:
        """What is a string there; numbers and objects are none."""
        found = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))

    def filled(v: Column, path: str) -> Column:
        return F.nullif(said(v, path), F.lit(""))

    def each(path: str, of) -> Column:
        items = F.try_variant_get(body, path, "array<variant>")
        return F.coalesce(F.transform(items, of), F.array().cast("array<string>"))

    def block(v: Column) -> Column:
        kind = said(v, "$.type")
        known = F.when(kind.isin(*PLAIN_BLOCKS), filled(v, "$.text")).when(kind == "refusal", filled(v, "$.refusal"))
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(known)

    what = F.coalesce(said(body, "$.type"), F.lit(""))
    call = F.array(F.concat(F.lit("[function_call: "), F.coalesce(said(body, "$.name"), F.lit("")), F.lit("]")), _cut_to(filled(body, "$.arguments"), INPUT_LIMIT))
    thought = each("$.content", lambda v: F.when(said(v, "$.type") == "reasoning_text", filled(v, "$.text")))
    item = (
        F.when(what == "message", F.concat(F.array(said(body, "$.content")), each("$.content", block)))
        .when(what == "function_call", call)
        .when(what == "function_call_output", F.array(_cut_to(said(body, "$.output"), TEXT_INPUT_LIMIT)))
        .when(what == "reasoning", F.concat(thought, each("$.summary", lambda v: filled(v, "$.text"))))
        .otherwise(F.array(filled(body, "$.text")))
    )
    kind = F.coalesce(F.try_variant_get(record, "$.type", "string"), F.lit(""))
    parts = F.when(kind == "compacted", F.array(filled(body, "$.message"))).when(kind == "turn_context", F.array(filled(body, "$.user_instructions"))).when(kind == "response_item", item)
    parts = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def token_count(text: Column) -> Column:
    """A token for each four characters, rounded up: stands in for a tokenizer. Callers that have one set the column `tokens` of their turns instead."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def tiers(turns: DataFrame, threshold: int) -> DataFrame:
    """Adds tier: user, long (system, more than threshold tokens) or short."""
    system = F.when(F.col("tokens") > threshold, "long").otherwise("short")
    return turns.withColumn("tier", F.when(F.col("kind") == "user", "user").otherwise(system))


def status(turns: DataFrame, budget: int) -> DataFrame:
    """conv_id, n_turns, total_tokens, status: within_budget, nothing_to_score or compacted."""
    total = F.sum("tokens").cast("long")
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), total.alias("total_tokens"),
        F.when(total <= budget, "within_budget").when(F.count_if(F.col("tier") == "long") == 0, "nothing_to_score").otherwise("compacted").alias("status"),
    )


def recent_query(turns: DataFrame, last: int = 3) -> DataFrame:
    """conv_id, query: the last user turns' texts, in order, joined by a rule; its last 4000 characters."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn_index").desc())
    recent = turns.where("kind = 'user'").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= last)
    texts = F.array_sort(F.collect_list(F.struct("turn_index", "text")))
    joined = F.array_join(F.transform(texts, lambda t: t["text"]), "\n---\n")
    return recent.groupBy("conv_id").agg(F.right(joined, F.lit(QUERY_LIMIT)).alias("query"))


def holdout(turns: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Adds part, prefix or suffix: the suffix starts at the first user turn from floor(n * ratio) on.

    Conversations without such a turn, or with an empty side, are left out.
    """
    whole = Window.partitionBy("conv_id")
    n = F.count("*").over(whole)
    cut = F.min(F.when((F.col("kind") == "user") & (F.col("turn_index") >= F.floor(n * ratio)), F.col("turn_index"))).over(whole)
    placed = turns.withColumn("_cut", cut).where(F.col("_cut") > 0)
    return placed.withColumn("part", F.when(F.col("turn_index") < F.col("_cut"), "prefix").otherwise("suffix")).drop("_cut")


def derived_budget(wanted: Column, tokens_before: Column) -> Column:
    """A positive wanted budget, else two fifths of the tokens before (40 000 at least), else 160 000."""
    given = wanted.try_cast("long")
    return F.when(given > 0, given).when(tokens_before.isNotNull(), F.greatest(F.floor(tokens_before * 0.4), F.lit(40000))).otherwise(F.lit(160000)).cast("long")
