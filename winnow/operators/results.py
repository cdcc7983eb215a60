"""Tables of results: repeats, Pareto frontiers, merges and what plots show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.entities import weight

# The budget and the seconds that stand in where a merged result has no speed, the counts of the earlier
# results, and what recalls are called.
SPEED_BUDGET, SPEED_DEFAULT = 2000, 1.2
EARLY_KEPT, EARLY_TOTAL = 7144, 81696
RECALL_BUDGET, RECALL_KEY, RECALL_LABEL = 20000, "recall_only", "TF-IDF (no composite)"
# End of fixed values.


def first_of(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row, by `order`, of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pareto(points: DataFrame, x: str, y: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """Points that no point of smaller x, or of equal x earlier by `order`, reaches in y."""
    w = Window.partitionBy(*(keys or [])).orderBy(x, order).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("_best", F.max(y).over(w)).where(F.col("_best").isNull() | (F.col(y) > F.col("_best"))).drop("_best")


def merge(judged: DataFrame, early: DataFrame, recalls: DataFrame, without: str) -> DataFrame:
    """One table of three: judged results but those of method `without`; earlier judged ones, which have neither speed nor
    counts of their own, with the speed that `recalls` has for the method at SPEED_BUDGET; and the recalls at RECALL_BUDGET.

    method, budget, model_key, model_label, composite (null for recalls), recall (null for the others), speed_s,
    kept_tokens, total_tokens. Of several speeds of a method the last by `ord` counts.
    """
    own = ["method", "budget", "model_key", "model_label", "composite"]
    none = F.lit(None).cast("double")
    known = recalls.where(F.col("budget") == SPEED_BUDGET).groupBy(F.col("method").alias("_m")).agg(F.max_by("speed_s", "ord").alias("_s"))
    first = judged.where(F.col("method") != without).select(*own, none.alias("recall"), "speed_s", "kept_tokens", "total_tokens")
    second = early.join(known, F.col("method") == F.col("_m"), "left")
    second = second.select(*own, none.alias("recall"), F.coalesce("_s", F.lit(SPEED_DEFAULT)).alias("speed_s"), F.lit(EARLY_KEPT).cast("long").alias("kept_tokens"), F.lit(EARLY_TOTAL).cast("long").alias("total_tokens"))
    third = recalls.where(F.col("budget") == RECALL_BUDGET).select("method", "budget", F.lit(RECALL_KEY).alias("model_key"), F.lit(RECALL_LABEL).alias("model_label"), none.alias("composite"), "recall", "speed_s", "kept_tokens", "total_tokens")
    return first.unionByName(second).unionByName(third)


def grid(methods: list[str], budgets: list[int], conversations: DataFrame) -> DataFrame:
    """conversations × methods × budgets: what a sweep has to run; two short lists of constants are exploded."""
    return conversations.withColumn("method", F.explode(F.array(*map(F.lit, methods)))).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))


def largest_budget(types: DataFrame) -> DataFrame:
    """types (method, budget, etype, coverage): of the largest budget, with the band of each type's weight."""
    top = F.max("budget").over(Window.partitionBy("method"))
    band = F.when(weight(F.col("etype")) >= 0.8, "high").when(weight(F.col("etype")) >= 0.6, "medium").otherwise("low")
    return types.withColumn("_top", top).where("budget = _top").select("method", "budget", "etype", "coverage", band.alias("band"))


def plot_points(results: DataFrame, x: str, y: str) -> DataFrame:
    """series, x, y, label (budgets in thousands) of the points that have a value."""
    label = F.concat((F.col("budget") / 1000).cast("int").cast("string"), F.lit("k"))
    return results.where(F.col(y).isNotNull()).select(F.col("method").alias("series"), F.col(x).alias("x"), F.col(y).alias("y"), label.alias("label"))
