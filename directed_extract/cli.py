"""Command line: extraction, evaluation, error reports, converters, and grids of runs.

The master and the resources are those of ``spark-submit``; nothing here sets them.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from directed_extract import config
from directed_extract.operators import detect, evaluate, grid, prepare, scoring
from directed_extract.session import cut, session
from directed_extract.sources import bio, jsonl, pubtator
from directed_extract.sources.completer import ATTEMPTS, CALLS_AT_ONCE, PAUSE, Completer, HttpCompleter, call_tally

#: Documents as the converters write and read them.
DOCUMENTS = "PMID string, Texto string, Entidad array<struct<texto string, tipo string>>"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="directed_extract")
    sub = p.add_subparsers(dest="command", required=True)

    def served(c: argparse.ArgumentParser) -> None:
        c.add_argument("--server", help="model server; without one only the exact detector runs")
        c.add_argument("--calls_at_once", type=int, default=CALLS_AT_ONCE)
        c.add_argument("--attempts", type=int, default=ATTEMPTS)
        c.add_argument("--pause", type=float, default=PAUSE, help="seconds between attempts")
        c.add_argument("--most_failed", type=float, default=0.2, help="share of failed calls above which the run is given up")

    run = sub.add_parser("extract", help="find each document's candidate entities")
    run.add_argument("--input_jsonl", required=True)
    run.add_argument("--benchmark_jsonl", help="only checked for existence")
    run.add_argument("--out_pred", default="predictions")
    run.add_argument("--limit", type=int, default=0)
    run.add_argument("--strategies", nargs="+", default=["all"])
    run.add_argument("--confidence_threshold", type=float)
    served(run)
    for i in (1, 2):
        for name, kind in (("target", int), ("overlap", int), ("min", int), ("max", int), ("temp", float)):
            run.add_argument(f"--s{i}_{name}", type=kind)
    for name, text in (("evaluate", "predictions against annotations"), ("errors", "false positives and false negatives in full")):
        c = sub.add_parser(name, help=text)
        c.add_argument("--predictions", required=True)
        c.add_argument("--reference", required=name == "errors", help="without one, predictions are compared with themselves")
        c.add_argument("--out", default=name)
    for name, text in (
        ("convert-bio", "a folder of .bio files to documents"), ("convert-pubtator", "PubTator text to documents"),
        ("filter", "documents with only their allowed entities"), ("candidates", "documents with the constant candidate block"),
    ):
        c = sub.add_parser(name, help=text)
        c.add_argument("--input", required=True)
        c.add_argument("--output", required=True)
    sub.choices["convert-pubtator"].add_argument("--no-dedup", action="store_true")
    sub.choices["filter"].add_argument("--allowed", help="text file with a name a line; without one, the list of the development set")
    g = sub.add_parser("grid", help="extraction at every point of a grid")
    g.add_argument("--kind", choices=("chunks", "temperatures"), required=True)
    g.add_argument("--input_jsonl", required=True)
    g.add_argument("--model", choices=("llama", "qwen"), default="llama")
    g.add_argument("--out_dir", help="by default named by kind and time")
    g.add_argument("--limit", type=int, default=grid.GRID_DOCUMENTS)
    served(g)
    a = sub.add_parser("analyze-grid", help="profiles, metrics, means and best runs of a grid's files")
    a.add_argument("--kind", choices=("chunks", "temperatures"), required=True)
    a.add_argument("--results", required=True)
    a.add_argument("--reference", required=True)
    return p


def problems(args: argparse.Namespace) -> list[str]:
    """What is wrong with the arguments."""
    out = []
    named = [getattr(args, n, None) for n in ("input_jsonl", "benchmark_jsonl", "predictions", "reference", "input", "allowed", "results")]
    out += [f"no such file: {p}" for p in named if p and "://" not in p and not os.path.exists(p)]
    if args.command in ("extract", "grid") and args.limit < 0:
        out.append("the limit must not be negative")
    if args.command == "extract" and args.confidence_threshold is not None and not 0 <= args.confidence_threshold <= 1:
        out.append("the confidence threshold must be between 0 and 1")
    return out


def chosen_strategies(args: argparse.Namespace) -> list[config.Strategy]:
    """The selected strategies with the overrides for the first and second of them; nothing global changes."""
    picked = config.select(args.strategies)
    for i in (1, 2):
        get = lambda n: getattr(args, f"s{i}_{n}")  # noqa: B023, E731
        picked = config.overridden(picked, i - 1, get("target"), get("overlap"), get("min"), get("max"), get("temp"))
    return picked


def predict(docs: DataFrame, strategies: list[config.Strategy], completer: Completer | None, thresholds: config.Thresholds) -> DataFrame:
    """Prediction rows ``(PMID, Texto, Entidad, _multi_strategy)`` of ``(line_num, pmid, text, candidates)``."""
    return predict_run(docs, strategies, completer, thresholds)[0]


def predict_run(docs: DataFrame, strategies: list[config.Strategy], completer: Completer | None, thresholds: config.Thresholds, calls: detect.Calls = detect.Calls()) -> tuple[DataFrame, DataFrame | None]:
    """The rows of :func:`predict`, and the model calls behind them if there were any."""
    found, made = detect.regex_detect(docs, F.col("line_num"), "text", "candidates"), None
    if completer is not None and strategies:
        asked = detect.model_run(docs, F.col("line_num"), "text", "candidates", strategies, completer, calls=calls)
        found, made = found.unionByName(asked.detections), asked.calls
    found = cut(found)
    weights = config.weights_frame(docs.sparkSession, strategies)
    scores = scoring.scored(found, weights)
    ordered = F.array_sort(F.collect_list(F.struct("entity", "confidence", "strategies")))
    by_doc = scores.groupBy("doc").agg(
        F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["entity"], x["confidence"]))).alias("entity_confidence"),
        F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["entity"], x["strategies"]))).alias("entity_strategies"),
    )
    lists = found.groupBy("doc", "strategy").agg(F.array_sort(F.collect_set("entity")).alias("e")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("strategy", "e"))).alias("all_detections"))
    rows = docs.withColumnRenamed("line_num", "doc").join(scoring.accepted_lists(scores, thresholds), "doc", "left").join(by_doc, "doc", "left").join(lists, "doc", "left")
    entity = lambda e: F.struct(e["texto"].alias("texto"), F.lit("SpecificDisease").alias("tipo"), e["confidence"].alias("confidence"), e["strategies"].alias("strategies"))
    limits = F.create_map(*[F.lit(x) for k in ("high", "medium", "low", "min_accept") for x in (k, getattr(thresholds, k))])
    used = F.array(*[F.lit(n) for n in (config.REGEX, *(s.name for s in strategies))])
    out = rows.select(
        F.col("pmid").alias("PMID"), F.col("text").alias("Texto"), F.coalesce(F.transform("entities", entity), F.array().cast("array<struct<texto:string,tipo:string,confidence:double,strategies:array<string>>>")).alias("Entidad"),
        F.struct("all_detections", "entity_confidence", "entity_strategies", limits.alias("confidence_thresholds"), used.alias("strategies_used")).alias("_multi_strategy"),
    )
    return out, made


def summaries(rows: DataFrame, seconds: float, calls: DataFrame | None = None, began: datetime | None = None) -> dict[str, DataFrame]:
    """What a run did: totals with its time, entities by strategy and by confidence, the range of confidence of each
    document, and its calls by status."""
    e = rows.select("PMID", F.explode_outer("Entidad").alias("e")).select("PMID", "e.*")
    spark, n = rows.sparkSession, rows.count()
    began = began or datetime.now(timezone.utc)
    when = spark.createDataFrame([(1, began.strftime("%Y%m%d_%H%M%S"), began.isoformat(), round(seconds, 3), round(seconds / n, 3) if n else 0.0)], "one int, run_id string, began string, seconds double, seconds_per_document double")
    total = e.agg(F.lit(n).alias("n_docs"), F.count("texto").alias("n_entities"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence")).withColumn("one", F.lit(1))
    accepted_rows = e.filter("texto is not null")
    out = {
        "run": when.join(total, "one").drop("one"), "strategies": scoring.strategy_counts(accepted_rows), "confidence": scoring.confidence_histogram(accepted_rows),
        "documents": scoring.confidence_ranges(rows.select("PMID", F.col("_multi_strategy.entity_confidence").alias("c"), F.size("Entidad").alias("n_accepted")), "c"),
    }
    return out | ({"calls": call_tally(calls, "round")} if calls is not None else {})


def _calls(args: argparse.Namespace) -> detect.Calls:
    return detect.Calls(args.calls_at_once, args.attempts, args.pause, args.most_failed)


def _completer(args: argparse.Namespace) -> Completer | None:
    return HttpCompleter(args.server) if args.server else None


def _extract(args: argparse.Namespace, spark: SparkSession) -> None:
    strategies = chosen_strategies(args)
    thresholds = config.Thresholds().updated(min_accept=args.confidence_threshold)
    spark.createDataFrame([(s.name, s.model, s.chunk_target, s.chunk_overlap, s.chunk_min, s.chunk_max, s.temperature, s.weight) for s in strategies], "name string, model string, target int, overlap int, min int, max int, temperature double, weight double").show(truncate=False)
    began, at = datetime.now(timezone.utc), time.monotonic()
    docs = cut(jsonl.read_documents(spark, args.input_jsonl, args.limit))
    rows, calls = predict_run(docs, strategies, _completer(args), thresholds, _calls(args))
    rows = cut(rows)
    seconds = time.monotonic() - at
    each = round(seconds / max(1, docs.count()), 3)
    jsonl.write_lines(rows.withColumn("_latency_sec", F.lit(each)), args.out_pred)
    for name, frame in summaries(rows, seconds, calls, began).items():
        if name == "documents":
            jsonl.write_lines(frame, f"{args.out_pred}_summary/{name}")
        else:
            frame.show(truncate=False)


def _loaded(args: argparse.Namespace, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, reference entities, and reference texts (of several rows of a document those of the last)."""
    lines = cut(jsonl.numbered_lines(spark, args.predictions).withColumn("file", F.lit(args.predictions)))
    own = cut(jsonl.numbered_lines(spark, args.reference)) if args.reference else lines
    predictions = cut(jsonl.predictions_from_lines(lines, "value", "line_num", "file"))
    gold = jsonl.predictions_from_lines(own.withColumn("file", F.lit("")), "value", "line_num", "file")
    latest = cut(evaluate.latest_gold(gold.withColumn("texts", F.transform("entities", lambda e: e["texto"])), "pmid", "doc", "texts"))
    texts = jsonl.documents_from_lines(own, "value", "line_num").groupBy("pmid").agg(F.max_by("text", "line_num").alias("text"))
    return predictions, latest, texts


def _evaluate(args: argparse.Namespace, spark: SparkSession) -> None:
    predictions, latest, _ = _loaded(args, spark)
    judged = cut(evaluate.evaluate_documents(predictions, latest))
    overall, by = evaluate.metrics(judged), evaluate.evaluate_strategies(predictions, latest)
    for name, frame in (("overall", overall), ("strategies", by), ("documents", judged)):
        jsonl.write_if_any(frame, f"{args.out}/{name}")
    overall.show(truncate=False)
    by.orderBy("strategy").show(truncate=False)
    prepare.samples(judged, "doc").select("pmid", F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall")).show()


def _errors(args: argparse.Namespace, spark: SparkSession) -> None:
    predictions, latest, texts = _loaded(args, spark)
    wrong, missed = cut(evaluate.false_positives(predictions, latest)), cut(evaluate.false_negatives(predictions, latest, texts))
    totals = evaluate.error_totals(predictions, latest)
    groups = {
        "false_positives": (wrong, wrong.select(F.explode("strategies").alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n"))),
        "false_negatives": (missed, missed.groupBy("pmid").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("entity")).alias("entities"))),
    }
    for name, (rows, by) in groups.items():
        if jsonl.write_if_any(rows, f"{args.out}/{name}"):
            jsonl.write_lines(by, f"{args.out}/{name}_by_group")
            jsonl.write_lines(totals, f"{args.out}/{name}_summary")
    totals.show(truncate=False)


def _converted(args: argparse.Namespace, spark: SparkSession) -> DataFrame | None:
    if args.command == "convert-bio":
        tokens = cut(bio.read_tokens(spark, args.input))
        return None if tokens.isEmpty() else bio.documents(tokens)
    if args.command == "convert-pubtator":
        return pubtator.parse(pubtator.read_lines(spark, args.input), not args.no_dedup).select("PMID", "Texto", "Entidad")
    docs = jsonl.read_strict(spark, args.input, DOCUMENTS)
    if args.command == "candidates":
        marked = cut(prepare.with_constant_candidates(docs, "Entidad", prepare.CANDIDATES))
        marked.agg(F.count("*").alias("n_docs"), F.count_if("had_entities").alias("n_with_own")).show()
        return marked.drop("had_entities")
    rows = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    names = spark.read.text(args.allowed).select(F.trim("value").alias("name")).filter("name <> ''") if args.allowed else spark.createDataFrame([(a,) for a in prepare.ALLOWED], "name string")
    kept = cut(prepare.filter_by_table(rows, "row", "Entidad", names, "name"))
    prepare.filter_statistics(kept, "Entidad").show()
    return kept.drop("row", "entities_before")


def _convert(args: argparse.Namespace, spark: SparkSession) -> None:
    out = _converted(args, spark)
    if out is None:
        print(f"no .bio files in {args.input}", file=sys.stderr)
        return
    rows = cut(out)
    jsonl.write_lines(rows, args.output)
    prepare.samples(rows, "PMID", "Entidad", 3).show(truncate=60)


def _grid(args: argparse.Namespace, spark: SparkSession) -> None:
    out = args.out_dir or f"{args.kind}_grid_{datetime.now(timezone.utc).strftime('%Y%m%d_%H%M%S')}"
    served = next(s.model for s in config.STRATEGIES if s.model.startswith(args.model))
    points = grid.chunk_points(args.model, served) if args.kind == "chunks" else grid.temperature_points(served)
    docs = cut(jsonl.read_documents(spark, args.input_jsonl, args.limit)).withColumnRenamed("line_num", "doc")
    done = grid.run(docs, F.col("doc"), "text", "candidates", points, _completer(args) or detect.NoModel(), _calls(args))
    jsonl.write_by_file(grid.lines_of(done.accepted, docs, points), "file", out)
    done.tally.show()


def _analyze(args: argparse.Namespace, spark: SparkSession) -> None:
    lines = cut(jsonl.numbered_lines(spark, args.reference).withColumn("file", F.lit("")))
    gold = jsonl.predictions_from_lines(lines, "value", "line_num", "file")
    latest = evaluate.latest_gold(gold.withColumn("texts", F.transform("entities", lambda e: e["texto"])), "pmid", "doc", "texts")
    chunks = args.kind == "chunks"
    got = cut(grid.results(cut(jsonl.read_prediction_files(spark, args.results)), latest).filter("model is not null" if chunks else "temperature is not null"))
    keys = ["model", "chunk", "overlap"] if chunks else ["temperature", "confidence"]
    means = grid.ordered(grid.group_means(got, [["model", "chunk"], ["model", "overlap"]] if chunks else [["temperature"], ["confidence"]]))
    tables = {"grid_search_analysis" if chunks else "temperature_grid_analysis": got.orderBy(*keys), "means": means, "top_f1": grid.top_results(got, "f1_score", keys), "top_entities": grid.top_results(got, "entities", keys)}
    for name, frame in tables.items():
        jsonl.write_csv(frame, f"{args.results}/{name}.csv")
        frame.show(100, truncate=False)


COMMANDS = {"extract": _extract, "evaluate": _evaluate, "errors": _errors, "grid": _grid, "analyze-grid": _analyze}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    wrong = problems(args)
    for w in wrong:
        print(w, file=sys.stderr)
    if wrong:
        return 1
    COMMANDS.get(args.command, _convert)(args, session())
    return 0


if __name__ == "__main__":
    sys.exit(main())
