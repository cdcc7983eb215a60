"""python -m winnow compact | evaluate | plot: the verbs on session files."""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.clients import Embedder, Reranker
from winnow.functions.text import status, tiers, token_count
from winnow.operators import results as R
from winnow.operators.scorers import SCORERS
from winnow.plans import compact as P
from winnow.sources import sessions, sinks

VERBS = ("compact", "evaluate", "plot")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="winnow", description="Compaction of agent transcripts under a token budget.")
    verbs = out.add_subparsers(dest="verb")
    for name in VERBS[:2]:
        verb = verbs.add_parser(name)
        verb.add_argument("sessions", help="session files: a path or a pattern")
        verb.add_argument("--records", choices=("blocks", "rollout"), default="blocks", help="format of the session files")
        verb.add_argument("--method", choices=(*SCORERS, "all"), default=P.METHOD)
        verb.add_argument("--budget", type=int, default=P.BUDGET)
        verb.add_argument("--short-threshold", type=int, default=P.THRESHOLD)
        verb.add_argument("--min-repeat-len", type=int, default=64)
        verb.add_argument("--batch-size", type=int, default=16)
        verb.add_argument("--embed-url", default="http://localhost:8080")
        verb.add_argument("--rerank-url", default="http://localhost:8181")
        verb.add_argument("--verbose", action="store_true")
        if name == "compact":
            verb.add_argument("--output", help="folder for a file of each session")
            verb.add_argument("--format", choices=("jsonl", "summary"), default="jsonl")
            verb.add_argument("--scores-file", help="folder for the scores, as CSV")
            verb.add_argument("--dry-run", action="store_true", help="random scores")
        else:
            verb.add_argument("--split-ratio", type=float, default=P.RATIO)
            verb.add_argument("--probes", help="table of probes, as Parquet: adds coverage of their evidence")
            verb.add_argument("--work", help="folder for intermediate tables that all executors share")
            verb.add_argument("--eval-output", help="folder for the results, as JSON")
    plot = verbs.add_parser("plot")
    plot.add_argument("results", nargs="+", help="JSON results")
    plot.add_argument("-o", "--output", help="folder for the plot's points, as CSV")
    plot.add_argument("-x", default="kept_tokens")
    plot.add_argument("-y", default="weighted_coverage")
    return out


def _turns(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return sessions.read_turns(spark, args.sessions, args.records).withColumn("tokens", token_count(F.col("text")))


def _options(args: argparse.Namespace, methods: list[str]) -> P.Options:
    """Services are asked whether they are up; those that are not have no option, and their methods fail by name."""
    out: P.Options = {"dedup": {"length": args.min_repeat_len}}
    for method, made in (("http-embed", Embedder(args.embed_url, batch=args.batch_size)), ("http-rerank", Reranker(args.rerank_url))):
        if method in methods:
            try:
                made.check()
            except OSError as e:
                print(f"{method}: {e}", file=sys.stderr)
            else:
                out[method] = {P.SERVED[method]: made}
    return out


def run_compact(spark: SparkSession, args: argparse.Namespace) -> int:
    turns, method = _turns(spark, args), "random" if args.dry_run else args.method
    if method == "all":
        raise SystemExit("compact takes one method")
    status(tiers(turns, args.short_threshold), args.budget).groupBy("status").count().show(truncate=False)
    selected = P.compact(turns, method, args.budget, args.short_threshold, **_options(args, [method]).get(method, {}))
    if args.output or args.scores_file or args.verbose:
        kept = selected.where("kept")
        if args.output and args.format == "summary":
            sinks.summary(kept).select("summary", "conv_id").write.mode("overwrite").partitionBy("conv_id").text(args.output)
        elif args.output:
            sinks.write_sessions(kept, args.output, sessions.header(spark, args.sessions) if args.records == "rollout" else None)
        if args.scores_file:
            sinks.write_scores(selected, args.scores_file)
        if args.verbose:
            sinks.score_detail(selected).show(100, truncate=100)
    sinks.stats(selected).show(20, truncate=False)
    return 0


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    work = args.work or tempfile.mkdtemp(prefix="winnow-")
    methods = P.methods_of(args.method)
    found = P.evaluate(_turns(spark, args), methods, work, _options(args, methods), budget=args.budget, threshold=args.short_threshold, ratio=args.split_ratio)
    for method, why in found.errors.items():
        print(f"{method}: {why}", file=sys.stderr)
    probes = spark.read.parquet(args.probes) if args.probes else None
    found.report().show(100, truncate=False)
    if probes is not None:
        found.evidence(probes).show(100, truncate=False)
        if args.verbose:
            found.dropped(probes).show(100, truncate=False)
    if args.eval_output:
        found.export(probes).select("value").write.mode("overwrite").text(args.eval_output)
    return 0


def run_plot(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = sessions.results(spark, args.results)
    points = R.plot_points(R.first_of(rows, ["method", args.x], "budget"), args.x, args.y).orderBy("series", "x")
    if args.output:
        points.coalesce(1).write.mode("overwrite").option("header", True).csv(args.output)
    points.show(200, truncate=False)
    R.pareto(points, "x", "y", "series").show(200, truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in VERBS and not argv[0].startswith("-"):
        argv.insert(0, VERBS[0])
    args = parser().parse_args(argv)
    if not args.verb:
        parser().print_help()
        return 1
    spark = SparkSession.builder.appName("winnow").getOrCreate()
    return {"compact": run_compact, "evaluate": run_evaluate, "plot": run_plot}[args.verb](spark, args)


if __name__ == "__main__":
    sys.exit(main())
