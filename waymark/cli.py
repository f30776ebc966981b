"""Command lines over the library: clean, analyze, evaluate, generate, matrix."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators import generator, graph, reports, runs, solver, tasks, worlds
from waymark.sources import records


def clean(spark: SparkSession, source: str, target: str, mode: str = "definite") -> None:
    records.write_jsonl(solver.clean(records.jsonl(spark, source), mode), target)


def analyze(spark: SparkSession, root: str, last: int = 2, wanted: list[str] | None = None, output: str | None = None) -> DataFrame:
    """The report's lines for the newest runs, or the wanted ones; with an output also the analysis document there."""
    meta = records.run_metadata(spark, root)
    if wanted:
        meta, missing = runs.chosen_runs(meta, wanted)
        for r in missing.collect():  # of a command line
            print(f"no run {r.run_id}")
    else:
        meta = runs.last_runs(meta, last)
    rank = F.row_number().over(Window.orderBy(F.col("timestamp").desc(), "run_id"))  # the chosen runs
    meta = meta.select("run_id", rank.alias("rank"))
    facts = runs.metrics(records.result_files(spark, root))
    value = lambda *names: F.coalesce(*[F.max(F.when(F.col("metric") == n, F.col("value"))) for n in names])
    found = facts.groupBy("run_id", "task").agg(value("acc", "accuracy", "exact_match", "em", "acc_gen", "strict_acc").alias("accuracy"), value("f1").alias("f1"))
    rows = runs.with_results(meta, found)
    summary = runs.summary(rows).join(meta, "run_id")
    answers = records.responses(spark, root).withColumn("scores", F.from_json("filtered", "array<array<string>>"))
    answers = answers.withColumn("predicted", runs.predicted_index(F.transform("scores", lambda r: F.get(r, F.lit(0)).try_cast("double"))).cast("long")).withColumn("target", F.col("target").try_cast("long"))
    wrong = runs.with_responses(rows.select("run_id", "task"), answers)
    errors = runs.errors(wrong.select("run_id", "task", "pos", "target", "predicted"), rows)
    if output:
        reports.write_analysis(reports.analysis(summary, rows, errors, ["rank"]), output)
    return reports.lines(summary, rows, errors, ["rank"])


def evaluate(spark: SparkSession, config: dict, specs: dict[str, dict], generate: tasks.Generate | None = None, score: tasks.Score | None = None, root: str = "results") -> str:
    """Run the configured tasks over their datasets and write the run's folder; returns its path."""
    responses, results = {}, None
    for name in config["tasks"]:
        rows, found = tasks.run(specs[name], records.dataset(spark, specs[name]), generate, score, config.get("limit"))
        responses[name], results = rows, found if results is None else results.union(found)
    return records.write_run(records.timestamped(root), results, responses, {"model": config.get("model")})


def generate(spark: SparkSession, target: str, maps: int, seed: str = "1", system: str = "Answer by letters.", plan: dict[str, int] | None = None) -> None:
    """Training samples over so many sampled maps, in target/train and target/test as JSON lines; with a plan so many of each kind."""
    drawn = worlds.sampled_relations(worlds.sampled_worlds(spark, maps, seed=seed), seed=seed)
    closed = graph.closure(graph.axis_edges(drawn))
    questions = generator.direction_questions(generator.ambiguous_pairs(drawn, closed, seed)).union(generator.count_questions(drawn, closed, seed)).union(generator.which_questions(drawn, closed, seed=seed))
    if plan:
        stratum = F.when(F.col("kind") == "count", F.col("kind")).otherwise(F.concat_ws("-", "kind", F.col("answers").cast("string")))
        questions = worlds.stratified(questions.withColumn("stratum", stratum), "stratum", plan, "map_id").drop("stratum")
    rows = generator.samples(drawn, questions, system)
    keyed = rows.withColumn("key", F.concat_ws("|", F.col("map_id").cast("string"), "kind", F.col("answers").cast("string")))
    parts = worlds.train_test(keyed, "key")
    for part in ("train", "test"):
        parts.where(F.col("split") == part).select("messages").write.mode("overwrite").json(f"{target}/{part}")


def matrix(spark: SparkSession, paths: list[str], metrics: list[str] | None = None) -> DataFrame:
    """The metric grid of results files; paths that don't exist are skipped."""
    files = records.existing(spark, paths)
    rows = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("run_id"), F.col("value").alias("json"))
    facts = runs.metrics(rows)
    return runs.grid(facts.where(F.col("metric").isin(*metrics)) if metrics else facts)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="waymark", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **options: dict) -> None:
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        for o, kw in options.items():
            p.add_argument(f"--{o}", **kw)

    command("clean", "source", "target", mode={"default": "definite", "choices": ["definite", "possible"]})
    command("analyze", "root", last={"type": int, "default": 2}, runs={"nargs": "*"}, output={})
    command("generate", "target", maps={"type": int, "default": 1000}, seed={"default": "1"}, plan={"type": json.loads})
    command("matrix", metrics={"nargs": "*"}, files={"nargs": "+", "required": True})
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    show: Callable[[DataFrame], None] = lambda rows: print("\n".join(r[0] for r in rows.collect()))  # noqa: E731 - a report
    if args.command == "clean":
        clean(spark, args.source, args.target, args.mode)
    elif args.command == "analyze":
        show(analyze(spark, args.root, args.last, args.runs, args.output).orderBy("pos").select("line"))
    elif args.command == "generate":
        generate(spark, args.target, args.maps, args.seed, plan=args.plan)
    else:
        show(matrix(spark, args.files, args.metrics).orderBy("metric", "task", "run_id").select(F.concat_ws("\t", "metric", "task", "run_id", F.col("value").cast("string"))))


if __name__ == "__main__":
    main()
