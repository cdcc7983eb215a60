"""Scorers: each turns (conv_id, turn_index, kind, text, tokens, tier) into scores (conv_id, turn_index, score, tokens) of
long system turns. Counts over a conversation take in all of its turns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.entities import explode_entities, weight
from winnow.functions.stretches import stretches
from winnow.sources.scratch import new_path

# The factor for entities that two scored turns at most hold, and what a model sees of a text.
EXCLUSIVE, EXCLUSIVE_TURNS = 1.2, 2
CLIENT_LIMIT, RERANK_BATCH = 2048, 64
SUMMARY_INPUT, SUMMARY_TOKENS = 600_000, 16_000
ASK = "Instruct: Find assistant responses from an AI coding conversation that contain information needed to continue the current task: code changes, decisions, errors, file paths, architectural context, or unfinished work.\nQuery: "
TELL = "Instruct: AI coding assistant response from a conversation history\nQuery: "
# End of fixed values.


def turn_frequency(turns: DataFrame) -> DataFrame:
    """conv_id, turn_index, is_long, etype, value, tf (turns that hold the entity), long_tf, itf = ln(turns / tf)."""
    marked = turns.withColumn("is_long", F.col("tier") == "long")
    rows = explode_entities(marked, ["conv_id", "turn_index", "is_long"])
    own = Window.partitionBy("conv_id", "etype", "value")
    rows = rows.withColumn("tf", F.count("*").over(own)).withColumn("long_tf", F.count_if("is_long").over(own))
    n = turns.groupBy(F.col("conv_id").alias("_c")).agg(F.count("*").alias("_n"))
    return rows.join(n, F.col("conv_id") == F.col("_c")).withColumn("itf", F.log(F.col("_n") / F.col("tf"))).drop("_c", "_n")


def _by_entities(turns: DataFrame, factor) -> DataFrame:
    terms = turn_frequency(turns).where("is_long")
    sums = terms.groupBy(F.col("conv_id").alias("_c"), F.col("turn_index").alias("_t")).agg(F.sum(weight(F.col("etype")) * F.col("itf") * factor).alias("_s"))
    long = turns.where("tier = 'long'").select("conv_id", "turn_index", "tokens")
    rows = long.join(sums, (F.col("conv_id") == F.col("_c")) & (F.col("turn_index") == F.col("_t")), "left")
    rows = rows.withColumn("raw", F.coalesce("_s", F.lit(0.0)) / F.sqrt(F.greatest("tokens", F.lit(1))))
    top = F.max("raw").over(Window.partitionBy("conv_id"))
    return rows.select("conv_id", "turn_index", (F.col("raw") / F.when(top > 0, top).otherwise(1.0)).alias("score"), "tokens")


def eitf(turns: DataFrame) -> DataFrame:
    """Weights times inverse turn frequencies of a turn's entities, by the root of its tokens; the best turn gets 1."""
    return _by_entities(turns, F.lit(1.0))


def setcover(turns: DataFrame) -> DataFrame:
    """As eitf, with more for entities that few scored turns hold."""
    return _by_entities(turns, F.when(F.col("long_tf") <= EXCLUSIVE_TURNS, EXCLUSIVE).otherwise(1.0))


def _rows_of(b: pa.RecordBatch, i: int, own: list[str], **made: np.ndarray) -> pa.RecordBatch:
    """Row i's own columns beside arrays of equal lengths."""
    same = [pa.repeat(b.column(c)[i], len(next(iter(made.values())))) for c in own]
    return pa.RecordBatch.from_arrays([*same, *[pa.array(x, pa.int64()) for x in made.values()]], names=[*own, *made])


def _again(rows: DataFrame, of: str) -> DataFrame:
    """The rows whose `of` (n: how often each row has it) its conversation has twice or more. Rows are written once; their
    counts are added up before they move, and a common value's rows are split where the two are joined."""
    path = new_path(rows.sparkSession, "stretches")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    often = rows.groupBy("conv_id", of).agg(F.sum("n").alias("_n")).where("_n > 1").select("conv_id", of)
    return rows.join(often.hint("merge"), ["conv_id", of], "left_semi")


def duplicate_share(texts: DataFrame, length: int = 64, block: int = 1 << 18) -> DataFrame:
    """texts (conv_id, turn_index, text) -> n_chars, n_duplicated: characters in a stretch of `length` characters that
    occurs twice or more in the conversation, overlaps and both places included.

    Equal stretches hold the same shorter ones, so that the least hash among these is equal, too. First only these least
    hashes meet, one for some 17 characters where length is 64; a stretch goes on only where its own is found twice, and
    meets its equals by a 64-bit hash, which alone decides. So what moves grows with what repeats. Texts are hashed
    `block` places at a time. (conv_id, turn_index) names a row; a null text has no count.
    """
    own = ["conv_id", "turn_index"]
    names = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in own)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                for _, _, low, short in stretches(text, length, block):
                    found, many = np.unique(short, return_counts=True)
                    kept = np.isin(found, low)
                    yield _rows_of(b, i, own, sign=found[kept].view(np.int64), n=many[kept])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, again) in enumerate(zip(b.column("text").to_pylist(), b.column("signs").to_pylist(), strict=True)):
                wanted = np.array(again, np.int64).view(np.uint64)
                for at, whole, low, _ in stretches(text, length, block):
                    p = np.flatnonzero(np.isin(low, wanted))
                    yield _rows_of(b, i, own, h=whole[p].view(np.int64), p=p + at, n=np.ones(len(p), np.int64))

    long = texts.select(*own, "text").where(F.length("text") >= length)
    signed = _again(long.mapInArrow(signs, f"{names}, sign long, n long"), "sign").groupBy(*own).agg(F.collect_set("sign").alias("signs"))
    windows = _again(long.join(signed, own).select(*own, "text", "signs").mapInArrow(places, f"{names}, h long, p long, n long"), "h")
    before = F.lag("p").over(Window.partitionBy(*own).orderBy("p"))
    covered = windows.withColumn("_d", F.least(F.lit(length), F.coalesce(F.col("p") - before, F.lit(length))))
    sums = covered.groupBy(F.col("conv_id").alias("_c"), F.col("turn_index").alias("_t")).agg(F.sum("_d").alias("_dup"))
    out = texts.join(sums, (F.col("conv_id") == F.col("_c")) & (F.col("turn_index") == F.col("_t")), "left")
    return out.select(*own, F.length("text").cast("long").alias("n_chars"), F.coalesce("_dup", F.lit(0)).cast("long").alias("n_duplicated"))


def dedup(turns: DataFrame, length: int = 64) -> DataFrame:
    """The share of a turn's characters that no repeated stretch covers; an empty text gets 1."""
    shares = duplicate_share(turns.select("conv_id", "turn_index", "text"), length).select(F.col("conv_id").alias("_c"), F.col("turn_index").alias("_t"), "n_chars", "n_duplicated")
    long = turns.where("tier = 'long'").select("conv_id", "turn_index", "tokens")
    rows = long.join(shares, (F.col("conv_id") == F.col("_c")) & (F.col("turn_index") == F.col("_t")))
    return rows.select("conv_id", "turn_index", F.when(F.col("n_chars") == 0, 1.0).otherwise(1 - F.col("n_duplicated") / F.col("n_chars")).alias("score"), "tokens")


def cosine(a: str, b: str):
    """(cosine + 1) / 2 of two array columns."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return (dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)) + 1) / 2


def embedded(turns: DataFrame, queries: DataFrame, embed: Callable[[list[str]], list[list[float]]], limit: int | None = None, ask: str = "", tell: str = "") -> DataFrame:
    """Similarity of each long turn to its conversation's query, by a caller's embedding of lists of texts, which runs on
    the executors: a local model or a client of a service.

    Turns go to it behind `tell` and queries, in calls of their own, behind `ask`, as the methods of SCORERS do; `limit`
    cuts turns, and never queries.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(vec=embed([tell + x[:limit] for x in p["text"]]), ask=embed([ask + x for x in p["query"]]))[["conv_id", "turn_index", "tokens", "vec", "ask"]]

    asked = queries.select(F.col("conv_id").alias("_c"), "query")
    rows = turns.where("tier = 'long'").join(asked, F.col("conv_id") == F.col("_c")).select("conv_id", "turn_index", "tokens", "text", "query")
    kind = turns.schema["conv_id"].dataType.simpleString()
    found = rows.mapInPandas(run, f"conv_id {kind}, turn_index long, tokens long, vec array<double>, ask array<double>")
    return found.select("conv_id", "turn_index", cosine("vec", "ask").alias("score"), "tokens")


def reranked(turns: DataFrame, queries: DataFrame, rerank: Callable[[str, list[str]], dict[int, float]]) -> DataFrame:
    """Scores by a caller's rerank(query, texts) -> score by position; what it leaves out gets 0."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("turn_index")
        scores = []
        for start in range(0, len(p), RERANK_BATCH):
            part = [x[:CLIENT_LIMIT] for x in p["text"][start : start + RERANK_BATCH]]
            got = rerank(p["query"].iloc[0], part)
            scores += [float(got.get(i, 0.0)) for i in range(len(part))]
        return p.assign(score=scores)[["conv_id", "turn_index", "score", "tokens"]]

    asked = queries.select(F.col("conv_id").alias("_c"), "query")
    rows = turns.where("tier = 'long'").join(asked, F.col("conv_id") == F.col("_c")).select("conv_id", "turn_index", "tokens", "text", "query")
    return rows.groupBy("conv_id").applyInPandas(run, f"conv_id {kind}, turn_index long, score double, tokens long")


def at_random(turns: DataFrame, seed: int = 0) -> DataFrame:
    """Seeded numbers in [0, 1) that depend on the turn alone."""
    h = F.pmod(F.xxhash64("conv_id", "turn_index", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return turns.where("tier = 'long'").select("conv_id", "turn_index", h.alias("score"), "tokens")


def summary_prompts(turns: DataFrame, budget: int) -> DataFrame:
    """conv_id, prompt, max_tokens: what a summarising model is given."""
    part = F.concat(F.lit("["), F.upper("kind"), F.lit(" turn "), F.col("turn_index").cast("string"), F.lit("]\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("turn_index", part.alias("part"))))
    joined = F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n---\n\n")
    return turns.groupBy("conv_id").agg(F.left(joined, F.lit(SUMMARY_INPUT)).alias("prompt"), F.lit(min(budget, SUMMARY_TOKENS)).alias("max_tokens"))


def summarised(turns: DataFrame, budget: int, summarise: Callable[[str, int], str]) -> DataFrame:
    """One system turn of index 0 for each conversation: a caller's summary of it."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"conv_id": p["conv_id"], "turn_index": 0, "kind": "system", "text": [summarise(x, int(n)) for x, n in zip(p["prompt"], p["max_tokens"], strict=True)]})

    return summary_prompts(turns, budget).mapInPandas(run, f"conv_id {kind}, turn_index long, kind string, text string")


SCORERS: dict[str, Callable[..., DataFrame]] = {"dedup": dedup, "eitf": eitf, "setcover": setcover, "embed": partial(embedded, ask=ASK, tell=TELL), "http-embed": partial(embedded, limit=CLIENT_LIMIT, ask=ASK, tell=TELL), "http-rerank": reranked}


def scorer(name: str) -> Callable[..., DataFrame]:
    if name not in SCORERS:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(SCORERS)}")
    return SCORERS[name]
