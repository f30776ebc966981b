"""Reports of analysed runs: one JSON document, and console lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import runs


def analysis(summary: DataFrame, tasks: DataFrame, errors: DataFrame, order: list[str]) -> DataFrame:
    """One row (json): summary by run, tasks with their runs, error patterns and the best run.

    It is meant for the runs that were chosen for a report, so it fits a row.
    """
    lists = [
        summary.agg(F.array_sort(F.collect_list(F.struct(*order, "run_id", "avg_accuracy", "avg_f1", "n_tasks"))).alias("summary")),
        runs.per_task(tasks, order).agg(F.array_sort(F.collect_list(F.struct("task", "runs"))).alias("per_task_breakdown")),
        errors.agg(F.array_sort(F.collect_list(F.struct(F.col("pattern").alias("category"), "count", "examples"))).alias("error_analysis")),
        runs.best(summary, [F.col(c) for c in order]).agg(F.max("run_id").alias("best_run")),
    ]
    row = lists[0]
    for other in lists[1:]:  # of one row each
        row = row.join(other)
    return row.select(F.to_json(F.struct("summary", "per_task_breakdown", "error_analysis", "best_run")).alias("json"))


def write_analysis(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").text(path)


def _shown(value: Column, as_percent: bool) -> Column:
    """A figure, or N/A where it is missing or zero."""
    two = F.round(value * 100).cast("long")
    text = runs.percent(value) if as_percent else F.format_string("%d.%02d", F.floor(two / 100), F.pmod(two, F.lit(100)))
    return F.when(F.coalesce(value, F.lit(0.0)) != 0, text).otherwise("N/A")


def lines(summary: DataFrame, tasks: DataFrame, errors: DataFrame, order: list[str], examples: int = 3) -> DataFrame:
    """(pos, line) of a console report in fixed-width columns: runs in order, the best run, each task's runs, error patterns with examples.

    For the runs chosen for a report: their lines are numbered in one task.
    """
    run = F.col("run_id").cast("string")
    none = F.lit("")
    part = lambda df, section, a, b, line: df.select(F.lit(section).alias("s"), a.alias("a"), b.alias("b"), line.alias("line"))
    rank = F.format_string("%012d", F.row_number().over(Window.orderBy(*order)))
    head = summary.sparkSession.createDataFrame([(0, "", "", "SUMMARY"), (1, "", "", f"{'Run ID':<25} {'Avg Acc':>10} {'Avg F1':>10} {'Tasks':>8}"), (4, "", "", "PER-TASK BREAKDOWN"), (6, "", "", "ERROR ANALYSIS")], "s int, a string, b string, line string")
    sum_line = F.format_string("%-25s %10s %10s %8d", run, _shown(F.col("avg_accuracy"), True), _shown(F.col("avg_f1"), False), F.col("n_tasks"))
    own = tasks.select("task", "accuracy", "f1", rank.alias("rank"))
    task_line = F.format_string("  %-25s %10s %10s", F.col("task"), _shown(F.col("accuracy"), True), _shown(F.col("f1"), False))
    shown = errors.select("pattern", F.posexplode(F.slice("examples", 1, examples)).alias("k", "example"))
    every = [
        head,
        part(summary, 2, rank, none, sum_line),
        part(runs.best(summary, [F.col(c) for c in order]), 3, none, none, F.concat(F.lit("Best run: "), run)),
        part(own.select("task").distinct(), 5, F.col("task"), none, F.concat(F.lit("Task: "), "task")),
        part(own, 5, F.col("task"), F.col("rank"), task_line),
        part(errors, 7, F.col("pattern"), none, F.format_string("%s (%d occurrences)", "pattern", "count")),
        part(shown, 7, F.col("pattern"), F.format_string("%06d", F.col("k") + 1), F.format_string("  %d. %s", F.col("k") + 1, "example")),
    ]
    out = every[0]
    for df in every[1:]:
        out = out.union(df)
    return out.select(F.row_number().over(Window.orderBy("s", "a", "b")).alias("pos"), "line")
