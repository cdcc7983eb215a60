"""Coverage of probes' evidence, and aggregation of judged answers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.clients import unfenced

# Dimensions of probes with weights, weights of difficulties, highest judged score, and gaps that matter.
DIMENSIONS = {"error_solution": 0.30, "instruction": 0.25, "progress": 0.25, "environment": 0.15, "noise": 0.05}
DIFFICULTIES = {"easy": 1.0, "medium": 2.0, "hard": 3.0}
TOP_SCORE, LARGE_GAP, SMALL_GAP = 3, 0.1, 0.02
PROMPT_LIMIT = 150_000
DIFFICULTY, VERSION, PROBES = "medium", "1", 25
ANSWER_TOKENS, JUDGE_TOKENS, PROBE_TOKENS = 1024, 256, 8192
# End of fixed values.


def _lookup(values: dict[str, float], key: Column, default: float | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def probe_coverage(probes: DataFrame, kept: DataFrame) -> DataFrame:
    """probes (conv_id, probe_ord, dimension, difficulty, evidence_turns) ⋈ kept (conv_id, kept_turns: array): coverage,
    kept_evidence, dropped_evidence. Probes without evidence are left out; repeated evidence counts each time."""
    rows = probes.join(kept.select(F.col("conv_id").alias("_c"), "kept_turns"), F.col("conv_id") == F.col("_c")).drop("_c")
    rows = rows.where(F.size("evidence_turns") > 0)
    held = F.filter("evidence_turns", lambda x: F.array_contains("kept_turns", x))
    lost = F.filter("evidence_turns", lambda x: ~F.array_contains("kept_turns", x))
    return rows.select("conv_id", "probe_ord", "dimension", "difficulty", (F.size(held) / F.size("evidence_turns")).alias("coverage"), held.alias("kept_evidence"), lost.alias("dropped_evidence"))


def dropped(coverage: DataFrame) -> DataFrame:
    return coverage.where("coverage < 1").select("conv_id", "probe_ord", "dimension", "coverage", "dropped_evidence")


def dimension_means(rows: DataFrame, keys: list[str], value: str = "coverage") -> DataFrame:
    """keys, dimension, weight, mean, n for every dimension; those that have no probe get mean 0 and n 0."""
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(w).alias("weight")) for d, w in DIMENSIONS.items()]))
    grid = rows.select(*keys).distinct().select(*keys, dims.alias("_d")).select(*keys, "_d.*")
    means = rows.groupBy(*keys, "dimension").agg(F.avg(value).alias("_mean"), F.count("*").alias("_n"))
    return grid.join(means, [*keys, "dimension"], "left").select(*keys, "dimension", "weight", F.coalesce("_mean", F.lit(0.0)).alias("mean"), F.coalesce("_n", F.lit(0)).alias("n"))


def composite(means: DataFrame, keys: list[str]) -> DataFrame:
    return means.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("mean")).alias("composite"))


def ndcg(rows: DataFrame, keys: list[str], value: str = "coverage", ideal: float = 1.0) -> DataFrame:
    """Discounted gain of values weighted by difficulty, harder probes first, over that of `ideal` everywhere."""
    order = Window.partitionBy(*keys).orderBy(F.col("_w").desc(), F.array_position(F.lit(list(DIMENSIONS)), F.col("dimension")), "probe_ord")
    ranked = rows.withColumn("_w", _lookup(DIFFICULTIES, F.col("difficulty"), 1.0)).withColumn("_i", F.row_number().over(order))
    gain = F.col("_w") / F.log2(F.col("_i") + 1)
    return ranked.groupBy(*keys).agg((F.sum(gain * F.col(value)) / F.sum(gain * ideal)).alias("ndcg"))


def judged(answers: DataFrame, probes: DataFrame) -> DataFrame:
    """answers (conv_id, probe_ord, model_key, model_label, score, ord, and method if there are several) of known probes,
    with their dimension and difficulty; scores are brought into 0..3."""
    known = probes.select(F.col("conv_id").alias("_c"), F.col("probe_ord").alias("_p"), "dimension", "difficulty")
    rows = answers.join(known, (F.col("conv_id") == F.col("_c")) & (F.col("probe_ord") == F.col("_p"))).drop("_c", "_p")
    return rows.withColumn("score", F.least(F.lit(TOP_SCORE), F.greatest(F.lit(0), F.coalesce("score", F.lit(0)))))


def judge_aggregate(rows: DataFrame) -> DataFrame:
    """method, budget (where rows have them), model_key, model_label (the first seen), composite of means / 3, n_answers,
    ndcg: over a conversation's answers, then the mean over conversations, so that no window spans all of a model's."""
    keys = [c for c in ("method", "budget") if c in rows.columns] + ["model_key"]
    means = dimension_means(rows.withColumn("_v", F.col("score") / TOP_SCORE), keys, "_v")
    label = rows.groupBy(*keys).agg(F.min_by("model_label", "ord").alias("model_label"), F.count("*").alias("n_answers"))
    gains = ndcg(rows, [*keys, "conv_id"], "score", float(TOP_SCORE)).groupBy(*keys).agg(F.avg("ndcg").alias("ndcg"))
    return label.join(composite(means, keys), keys).join(gains, keys)


def model_gap(aggregates: DataFrame) -> DataFrame:
    """The gap between the capable and the cheap model, of each method where there are several, and what it says."""
    of = lambda k: F.max(F.when(F.col("model_key") == k, F.col("composite")))
    keys = [c for c in ("method", "budget") if c in aggregates.columns]
    gap = aggregates.groupBy(*keys).agg((of("capable") - of("cheap")).alias("gap"))
    says = F.when(F.col("gap") > LARGE_GAP, "context lacks detail").when(F.col("gap") < SMALL_GAP, "similar").otherwise("moderate")
    return gap.select(*keys, "gap", says.alias("insight"))


def _entry() -> Column:
    """A turn as it is shown to a model that writes probes."""
    head = F.concat(F.lit("--- Turn "), F.col("turn_index").cast("string"), F.lit(" ("), F.col("kind"), F.lit(") ---"))
    return F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))


def prompt_prefix(turns: DataFrame, limit: int = PROMPT_LIMIT) -> DataFrame:
    """The turns (conv_id, turn_index, kind, text) before the first whose entry would exceed `limit` characters in all."""
    size = F.sum(F.length(_entry())).over(Window.partitionBy("conv_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("_size", size).where(F.col("_size") <= limit).drop("_size")


def transcript(turns: DataFrame, limit: int = PROMPT_LIMIT) -> DataFrame:
    """conv_id, transcript: the entries of the prefix, joined by line feeds, and a note where it is not the whole."""
    shown = prompt_prefix(turns, limit).withColumn("_entry", _entry())
    entries = F.array_sort(F.collect_list(F.struct("turn_index", "_entry")))
    shown = shown.groupBy(F.col("conv_id").alias("_c")).agg(F.transform(entries, lambda e: e["_entry"]).alias("_e"))
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("_n")).join(shown, F.col("conv_id") == F.col("_c"), "left")
    entries = F.coalesce("_e", F.array().cast("array<string>"))
    left = (F.col("_n") - F.size(entries)).cast("string")
    note = F.concat(F.lit(f"\n[...truncated at {limit} chars, "), left, F.lit(" turns shown...]"))
    return whole.select("conv_id", F.array_join(F.when(F.size(entries) < F.col("_n"), F.concat(entries, F.array(note))).otherwise(entries), "\n").alias("transcript"))


def ask(rows: DataFrame, schema: str, client, retries: int = 5) -> DataFrame:
    """Run a caller's client(row as dict) -> dict on the executors: probe generation, answers or judgements.

    A call that keeps failing gives the row {"error": text}; waits double from three seconds.
    """
    import time
    from collections.abc import Iterator

    import pandas as pd

    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for row in p.to_dict("records"):
                for attempt in range(retries):
                    try:
                        got = client(row)
                        break
                    except Exception as e:
                        got = {"error": f"[ERROR: {e}]"}
                        if attempt + 1 < retries:
                            time.sleep(3 * 2**attempt)
                out.append({n: {**row, **got}.get(n) for n in names})
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def write_probes(conversations: DataFrame, client, instruction: str, model: str) -> DataFrame:
    """conversations (conv_id, transcript) -> probes (conv_id, probe_ord, probe_id, dimension, tier, question, gold_answer,
    evidence_turns, difficulty) that a model writes, one call for each conversation; a reply that is no array of objects
    with these names fails the job, as does a client that gives up."""
    import pandas as pd

    names = ("id", "dimension", "tier", "question", "gold_answer")

    def run(batches):
        for p in batches:
            rows = []
            for conv_id, text in zip(p["conv_id"], p["transcript"], strict=True):
                said = f"{instruction}\n\n<conversation>\n{text}\n</conversation>"
                for i, probe in enumerate(json.loads(unfenced(client(model, "", said, PROBE_TOKENS)))):
                    rows.append((conv_id, i, *(probe[n] for n in names), [int(x) for x in probe.get("evidence_turns", [])], probe.get("difficulty", DIFFICULTY)))
            yield pd.DataFrame(rows, columns=["conv_id", "probe_ord", "probe_id", *names[1:], "evidence_turns", "difficulty"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return conversations.select("conv_id", "transcript").mapInPandas(run, f"conv_id {kind}, probe_ord long, probe_id string, dimension string, tier string, question string, gold_answer string, evidence_turns array<long>, difficulty string")


def answer(probes: DataFrame, contexts: DataFrame, models: dict[str, tuple[str, str]], client, instruction: str) -> DataFrame:
    """Answers of each model (key -> name, label) to each probe from its conversation's context (conv_id, context, and
    method and budget if there are several): adds model_key, model_label, ord and answer, an error's text where calls fail."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("model_key"), F.lit(label).alias("model_label"), F.lit(name).alias("_model"), F.lit(i).alias("_nth")) for i, (k, (name, label)) in enumerate(models.items())]))
    rows = probes.join(contexts, "conv_id").withColumn("_m", each).select("*", "_m.*").drop("_m")
    rows = rows.withColumn("ord", (F.col("_nth") * (1 << 32) + F.col("probe_ord")).cast("long"))
    rows = rows.withColumn("_said", F.concat(F.lit("<context>\n"), F.col("context"), F.lit("\n</context>\n\nQuestion: "), F.col("question")))

    def run(batches):
        for p in batches:
            out = []
            for model, said in zip(p["_model"], p["_said"], strict=True):
                try:
                    out.append(client(model, instruction, said, ANSWER_TOKENS))
                except Exception as e:
                    out.append(f"[ERROR: {e}]")
            yield p.drop(columns=["_model", "_nth", "_said", "context"]).assign(answer=out)

    kept = [f for f in rows.schema.fields if f.name not in ("_model", "_nth", "_said", "context")]
    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", answer string")


def judge(answers: DataFrame, client, instruction: str, model: str) -> DataFrame:
    """Adds score (0 to 3) and judge_reasoning to answers with their question and gold_answer. Answers to no known probe (a
    null question) and replies that can't be read get 0, and a reason."""

    def run(batches):
        for p in batches:
            out = []
            for question, gold, said in zip(p["question"], p["gold_answer"], p["answer"], strict=True):
                if question is None:
                    out.append((0, "Probe not found"))
                    continue
                try:
                    reply = client(model, instruction, f"Question: {question}\n\nGold answer: {gold}\n\nCandidate answer: {said}", JUDGE_TOKENS)
                    got = json.loads(unfenced(reply))
                    out.append((min(TOP_SCORE, max(0, int(got.get("score", 0)))), str(got.get("reasoning", ""))))
                except Exception as e:
                    out.append((0, f"Judge error: {e}"))
            yield p.assign(score=[x for x, _ in out], judge_reasoning=[x for _, x in out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema.fields)
    return answers.mapInPandas(run, f"{schema}, score int, judge_reasoning string")


def traces(judged: DataFrame, answer_instruction: str, judge_instruction: str) -> DataFrame:
    """method, budget, trace: JSON of each run's answers with their prompts, scores and reasons, in order of `ord`."""
    own = [c for c in ("conv_id", "probe_id", "dimension", "tier", "difficulty", "model_key", "model_label", "question", "gold_answer", "evidence_turns", "score", "judge_reasoning") if c in judged.columns]
    asked = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nGold answer: "), F.col("gold_answer"), F.lit("\n\nCandidate answer: "), F.col("answer"))
    row = F.struct(*own, F.col("answer").alias("generated_answer"), F.lit(answer_instruction).alias("answer_system_prompt"), F.lit(judge_instruction).alias("judge_system_prompt"), asked.alias("judge_user_prompt"))
    known = judged.where("question is not null")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "conv_id", row.alias("row")))), lambda e: e["row"])
    probes, answers = F.count_distinct("conv_id", "probe_ord").alias("probe_count"), F.count("*").alias("answer_count")
    found = known.groupBy("method", "budget").agg(probes, answers, rows.alias("entries"))
    return found.select("method", "budget", F.to_json(F.struct("method", "budget", "probe_count", "answer_count", "entries")).alias("trace"))
