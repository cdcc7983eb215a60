"""The verbs: compact a table of turns, evaluate methods on it by entities, evidence or TF-IDF recall, and sweep budgets."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.entities import explode_entities
from winnow.functions.text import holdout, recent_query, status, tiers
from winnow.operators import coverage as C
from winnow.operators import evidence as V
from winnow.operators import fitness as I
from winnow.operators.scorers import SCORERS, at_random, scorer
from winnow.operators.selection import select_turns
from winnow.sources.scratch import file_system
from winnow.sources.sinks import stats

#: Budget in tokens, tokens above which a turn is long, share of turns in the prefix, and method unless told otherwise.
BUDGET, THRESHOLD, RATIO, METHOD = 80_000, 300, 0.7, "eitf"
#: Methods that need no service, and the key and argument of those that do.
LOCAL = ("dedup", "eitf", "setcover")
SERVED = {"embed": "embed", "http-embed": "embed", "http-rerank": "rerank"}
Options = dict[str, dict]


def scores(turns: DataFrame, method: str, options: Options | None = None) -> DataFrame:
    """Scores by a method; options has its arguments by method: {"dedup": {"length": 64}, "embed": {"embed": f}, ...}.

    Methods that compare with a query get the conversation's last user turns, unless the options have `queries`.
    """
    if method == "random":
        return at_random(turns, **(options or {}).get(method, {}))
    found, given = scorer(method), dict((options or {}).get(method, {}))
    if method in SERVED:
        if SERVED[method] not in given:
            raise ValueError(f"method {method!r} needs the option {SERVED[method]!r}")
        given.setdefault("queries", recent_query(turns))
    return found(turns, **given)


def compact(turns: DataFrame, method: str = METHOD, budget: int = BUDGET, threshold: int = THRESHOLD, **given) -> DataFrame:
    """The selection of every conversation that exceeds the budget and has a long turn; see operators.selection."""
    marked = tiers(turns, threshold)
    due = status(marked, budget).where("status = 'compacted'").select(F.col("conv_id").alias("_c"))
    marked = marked.join(due, F.col("conv_id") == F.col("_c"), "left_semi")
    return select_turns(marked, scores(marked, method, {method: given}), budget)


def methods_of(method: str | Iterable[str]) -> list[str]:
    """`all` stands for every method; a list of names for itself."""
    return list(SCORERS) if method == "all" else [method] if isinstance(method, str) else list(method)


def _numbers(selected: DataFrame) -> DataFrame:
    """A selection without texts: what a written copy of it needs."""
    return selected.select("conv_id", "turn_index", "kind", "tokens", "tier", "score", "adjusted", "kept", "reason")


class Evaluation:
    """Methods on the same held-out turns, each written once below `folder`.

    The turns' entities are extracted once, for all methods. A method that fails is left out; `errors` says why. `seconds`
    has the wall time of each selection.
    """

    def __init__(self, turns: DataFrame, folder: str, budget: int = BUDGET, threshold: int = THRESHOLD, ratio: float = RATIO) -> None:
        self.spark = turns.sparkSession
        self.folder, self.budget = folder.rstrip("/"), budget
        parts = self._written(tiers(holdout(turns, ratio), threshold), "turns")
        self.prefix, self.suffix = parts.where("part = 'prefix'"), parts.where("part = 'suffix'")
        self.needed = self._written(explode_entities(C.joined_text(self.suffix.where("kind = 'system'")), ["conv_id"]), "needed")
        self.selected: dict[str, DataFrame] = {}
        self.seconds: dict[str, float] = {}
        self.errors: dict[str, str] = {}

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def run(self, method: str | Iterable[str], options: Options | None = None) -> Evaluation:
        for m in methods_of(method):
            began = time.monotonic()
            try:
                chosen = _numbers(select_turns(self.prefix, scores(self.prefix, m, options), self.budget))
                self.selected[m] = self._written(chosen, f"selected-{m}")
                self.seconds[m] = time.monotonic() - began
            except Exception as e:
                self.errors[m] = f"{type(e).__name__}: {e}"
        if not self.selected:
            raise ValueError(f"no method gave a result: {self.errors}")
        return self

    def _each(self, of: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
        out = None
        for m, s in self.selected.items():
            rows = of(m, s)
            own = [F.lit(m).alias("method"), F.lit(self.budget).alias("budget"), *rows.columns]
            out = rows.select(*own) if out is None else out.unionByName(rows.select(*own))
        return out

    def _held(self, selected: DataFrame) -> DataFrame:
        kept = selected.where("kept").select(F.col("conv_id").alias("_c"), F.col("turn_index").alias("_t"))
        return self.prefix.join(kept, (F.col("conv_id") == F.col("_c")) & (F.col("turn_index") == F.col("_t")), "left_semi")

    def types(self) -> DataFrame:
        """method, budget, conv_id, etype, covered, total, coverage, weight."""
        return self._each(lambda m, s: C.type_breakdown(C.covered_of(self.needed, self._held(s))))

    def entities(self) -> DataFrame:
        """method, budget, conv_id, speed_s and the coverage of what each method keeps of the prefix."""

        def of(m: str, s: DataFrame) -> DataFrame:
            sizes = stats(s).select("conv_id", "total_tokens", "kept_tokens")
            own = C.coverage(sizes, C.type_breakdown(C.covered_of(self.needed, self._held(s))))
            return own.withColumn("speed_s", F.lit(self.seconds[m]))

        return self._each(of)

    def _probe_rows(self, probes: DataFrame) -> DataFrame:
        return self._each(lambda m, s: V.probe_coverage(probes, s.groupBy("conv_id").agg(F.collect_list(F.when(F.col("kept"), F.col("turn_index"))).alias("kept_turns"))))

    def evidence(self, probes: DataFrame) -> DataFrame:
        """method, budget, conv_id, composite, ndcg: of the probes' evidence that each method keeps."""
        rows, keys = self._probe_rows(probes), ["method", "budget", "conv_id"]
        return V.composite(V.dimension_means(rows, keys), keys).join(V.ndcg(rows, keys), keys)

    def dropped(self, probes: DataFrame) -> DataFrame:
        """The probes that a method does not keep the whole evidence of."""
        return self._probe_rows(probes).where("coverage < 1")

    def recall(self) -> DataFrame:
        """method, budget, conv_id, recall, f1, and what the published sweeps hold besides: by terms of the suffix.

        Conversations whose suffix has no term have no row.
        """
        later = self.suffix.where("kind = 'system'")
        relevances = I.relevance(self.prefix, later)
        known = I.vocabulary(later, ["conv_id"]).select("conv_id").distinct().withColumnRenamed("conv_id", "_v")

        def of(m: str, s: DataFrame) -> DataFrame:
            return I.evaluated(relevances, s).join(known, F.col("conv_id") == F.col("_v"), "left_semi").withColumn("speed_s", F.lit(self.seconds[m]))

        return self._each(of)

    def report(self) -> DataFrame:
        """metric by rows, methods by columns: the types by falling weight, then the sums; means over conversations."""
        methods = list(self.selected)
        by_type = self.types().select(F.col("etype").alias("metric"), "method", F.col("coverage").alias("value"), F.col("weight").alias("_w"))
        types = by_type.groupBy(F.lit(0).alias("block"), F.col("_w").alias("weight"), "metric")
        sums = ["coverage", "weighted_coverage", "compression", "f1", "suffix_entity_count", "covered_count", "kept_tokens", "total_tokens", "speed_s"]
        total = C.report(self.entities(), sums, methods).select(F.lit(1).alias("block"), F.lit(0.0).alias("weight"), "metric", *methods)
        return types.pivot("method", methods).agg(F.avg("value")).unionByName(total).orderBy("block", F.col("weight").desc(), "metric").drop("block")

    def export(self, probes: DataFrame | None = None) -> DataFrame:
        """conv_id, value: for each conversation a JSON array of the methods' results, as `evaluate --eval-output` writes."""
        types = F.map_from_entries(F.array_sort(F.collect_list(F.struct("etype", F.struct("covered", "total", "coverage", "weight").alias("of")))))
        by_type = self.types().groupBy("method", "conv_id").agg(types.alias("type_coverage"))
        rows = self.entities().join(by_type, ["method", "conv_id"], "left")
        if probes is not None:
            rows = rows.join(self.evidence(probes).drop("budget"), ["method", "conv_id"], "left")
        own = F.to_json(F.struct(*[c for c in rows.columns if c != "conv_id"])).alias("own")
        each = F.transform(F.array_sort(F.collect_list(F.struct("method", own))), lambda e: e["own"])
        return rows.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]")).alias("value"))


def evaluate(turns: DataFrame, methods: str | list[str], folder: str, options: Options | None = None, **given) -> Evaluation:
    """Evaluate methods (`all`: every one) on turns; intermediate tables go below folder."""
    return Evaluation(turns, folder, **given).run(methods, options)


def sweep(turns: DataFrame, methods: list[str], budgets: list[int], folder: str, options: Options | None = None, **given) -> DataFrame:
    """Evaluation.recall of each method and budget; those that stand in folder/results are not run again."""
    spark, path = turns.sparkSession, f"{folder.rstrip('/')}/results"
    for budget in budgets:
        for method in methods:
            own = f"{path}/method={method}/budget={budget}"
            done, fs = file_system(spark, f"{own}/_SUCCESS")
            if fs.exists(done):
                continue
            run = partial(evaluate, turns, method, f"{folder}/run-{method}-{budget}", options, budget=budget, **given)
            try:
                found = run().recall()
            except ValueError:
                continue  # the method failed: the others go on
            found.drop("method", "budget").write.mode("overwrite").parquet(own)
    return spark.read.option("basePath", path).parquet(f"{path}/method=*/budget=*")
