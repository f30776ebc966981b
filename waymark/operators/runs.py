"""Evaluation runs: the metrics table, summaries, best run, error examples and the metric matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import scoring

_SKIP = ("name", "alias", "sample_len")
_KNOWN = ("acc", "accuracy", "f1", "exact_match", "em", "mcc")


def metrics(results: DataFrame) -> DataFrame:
    """(run_id, task, metric, filter, value, stderr) of results (run_id, json).

    Reads both layouts, results[task] and [task].results[task]. Keys are
    "metric,filter"; "metric_stderr,filter" belongs to its metric and is
    dropped without one. Only numbers count; of a metric's filters the last wins.
    """
    kind = "map<string, map<string, string>>"
    flat = F.from_json(F.get_json_object("json", "$.results"), kind)
    nested = F.map_from_entries(F.filter(F.transform(F.map_entries(F.from_json("json", "map<string, string>")), lambda e: F.struct(e["key"].alias("key"), F.try_element_at(F.from_json(F.get_json_object(e["value"], "$.results"), kind), e["key"]).alias("value"))), lambda e: e["value"].isNotNull()))
    rows = results.select("run_id", F.explode(F.coalesce(flat, nested)).alias("task", "m")).select("run_id", "task", F.posexplode("m").alias("pos", "key", "raw"))
    base = F.substring_index("key", ",", 1)
    rows = rows.select("run_id", "task", "pos", base.alias("base"), F.when(F.contains("key", F.lit(",")), F.substring_index("key", ",", -1)).alias("filter"), F.expr("try_cast(raw as double)").alias("value"))
    rows = rows.where(F.col("value").isNotNull() & ~F.col("base").isin(*_SKIP))
    error = F.col("base").endswith("_stderr")
    rows = rows.withColumn("metric", F.regexp_replace("base", "_stderr$", ""))
    last = lambda c, when: F.max_by(F.when(when, c), F.when(when, F.col("pos")))
    out = rows.groupBy("run_id", "task", "metric").agg(last(F.col("value"), ~error).alias("value"), last(F.col("filter"), ~error).alias("filter"), last(F.col("value"), error).alias("stderr"))
    return out.where("value is not null").select("run_id", "task", "metric", "filter", "value", "stderr")


def custom_metrics(m: Column) -> Column:
    """Of a map of metric keys those that are none of the known ones nor their errors."""
    base = lambda k: F.substring_index(k, ",", 1)
    return F.map_filter(m, lambda k, _: ~F.regexp_like(base(k), F.lit("^(" + "|".join(_KNOWN) + ")")) & ~k.endswith("_stderr"))


def lookup(m: Column, *names: str) -> Column:
    """The first of the names that is a key, exactly or before a comma."""
    prefixed = lambda name: F.get(F.map_values(F.map_filter(m, lambda k, _: k.startswith(name + ","))), F.lit(0))
    return F.coalesce(*[c for n in names for c in (F.try_element_at(m, F.lit(n)), prefixed(n))])


def task_label(task: Column) -> Column:
    return F.translate(F.regexp_replace(task, "^spatial_eval_(gen_)?", ""), "_", " ")


def summary(rows: DataFrame) -> DataFrame:
    """Per run the mean accuracy and f1 (nulls aside) and the number of tasks, of rows (run_id, task, accuracy, f1)."""
    return rows.groupBy("run_id").agg(F.avg("accuracy").alias("avg_accuracy"), F.avg("f1").alias("avg_f1"), F.count("*").alias("n_tasks"))


def best(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The run with the highest avg_accuracy (null counts as 0); ties go to the first in order."""
    return rows.orderBy(F.coalesce("avg_accuracy", F.lit(0.0)).desc(), *order).limit(1)


def last_runs(runs: DataFrame, n: int = 2) -> DataFrame:
    """The n newest runs by timestamp, ties by run_id."""
    return runs.orderBy(F.col("timestamp").desc(), "run_id").limit(n)


def rounded(c: Column | str, digits: int) -> Column:
    """c to so many decimals by scaling in floating point, as SQL engines round a double; F.round goes by its decimal text, and the two differ in halves."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 10.0**digits) / 10.0**digits


def percent(share: Column) -> Column:
    """A share as a percentage with two decimals."""
    h = F.round(share * 10000).cast("long")
    return F.format_string("%d.%02d%%", F.floor(h / 100), F.pmod(h, F.lit(100)))


def predicted_index(scores: Column) -> Column:
    """The choice that scores an array of per-choice scores, the first of equals; null without any."""
    return F.when(F.size(scores) > 0, scoring.best_index(scores))


def errors(responses: DataFrame, tasks: DataFrame, low: float = 0.5, n: int = 5) -> DataFrame:
    """(pattern, count, examples) from responses (run_id, task, pos, target, predicted) and tasks (run_id, task, accuracy).

    A task below `low` is an example of "Low accuracy on <task>"; of the wrong
    answers of a run and task the first n are examples of "Misclassification
    in <task>". target and predicted are indexes of choices. count is of all
    kept, examples lists the first n by run and position. Counts are added up
    before they meet, and of each pattern only the first n examples are ranked.
    """
    poor = tasks.where((F.col("accuracy") < low) & F.col("accuracy").isNotNull()).select(F.concat(F.lit("Low accuracy on "), "task").alias("pattern"), "run_id", F.lit(0).cast("long").alias("pos"), F.concat(F.col("run_id").cast("string"), F.lit(": "), percent(F.col("accuracy"))).alias("example"))
    wrong = responses.where((F.col("predicted") != F.col("target")) & F.col("predicted").isNotNull() & F.col("target").isNotNull())
    wrong = wrong.withColumn("_r", F.row_number().over(Window.partitionBy("run_id", "task").orderBy("pos"))).where(F.col("_r") <= n)
    named = lambda c: F.concat(scoring.letter(F.col(c).cast("int")), F.lit(" (idx "), F.col(c).cast("string"), F.lit(")"))
    example = F.concat(F.col("run_id").cast("string"), F.lit(" doc="), F.col("pos").cast("string"), F.lit(": predicted="), named("predicted"), F.lit(", expected="), named("target"))
    wrong = wrong.select(F.concat(F.lit("Misclassification in "), "task").alias("pattern"), "run_id", F.col("pos").cast("long").alias("pos"), example.alias("example"))
    every = poor.union(wrong)
    counts = every.groupBy("pattern").agg(F.count("*").alias("count"))
    first = every.withColumn("_r", F.row_number().over(Window.partitionBy("pattern").orderBy("run_id", "pos"))).where(F.col("_r") <= n)
    shown = first.groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "example"))), lambda s: s["example"]).alias("examples"))
    return counts.join(shown, "pattern")


def matrix(facts: DataFrame, values: list[str] | None = None, scale: float = 100.0, rows: str = "task", across: str = "run_id") -> DataFrame:
    """(metric, rows, one column for each value of across): value * scale, missing 0; metrics that are nowhere above 0 are dropped."""
    kept = facts.join(positive_metrics(facts), "metric", "left_semi").groupBy("metric", rows)
    out = (kept.pivot(across, values) if values else kept.pivot(across)).agg(F.round(F.max("value") * scale, 6))
    return out.fillna(0.0)


def positive_metrics(facts: DataFrame) -> DataFrame:
    """The metrics that are above 0 in some run and task."""
    return facts.groupBy("metric").agg(F.max("value").alias("m")).where("m > 0").select("metric")


def metric_names(*facts: DataFrame) -> DataFrame:
    """(pos, metric): the metrics that any of the tables has, in order of their names."""
    every = facts[0].select("metric")
    for f in facts[1:]:
        every = every.union(f.select("metric"))
    every = every.distinct()
    return every.select(F.row_number().over(Window.orderBy("metric")).alias("pos"), "metric")  # a row a metric


def first_seen(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(pos, name): the distinct names in the order in which they first appear."""
    first = rows.groupBy(name).agg(F.min(F.struct(*order)).alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at", name)).alias("pos"), name)  # a row a name


def grid(facts: DataFrame, scale: float = 100.0) -> DataFrame:
    """(metric, task, run_id, value): the cells of matrix as rows, for any number of runs."""
    rows = facts.join(positive_metrics(facts), "metric", "left_semi").groupBy("metric", "task", "run_id").agg(F.round(F.max("value") * scale, 6).alias("value"))
    cells = rows.select("metric", "task").distinct().crossJoin(rows.select("run_id").distinct())  # the grid itself is the result
    return cells.join(rows, ["metric", "task", "run_id"], "left").fillna(0.0, ["value"])


def chosen_runs(runs: DataFrame, wanted: list) -> tuple[DataFrame, DataFrame]:
    """The runs with the wanted run_ids, and (run_id) of those that there are none of."""
    asked = runs.sparkSession.createDataFrame([(w,) for w in wanted], f"run_id {runs.schema['run_id'].dataType.simpleString()}")
    return runs.join(F.broadcast(asked), "run_id", "left_semi"), asked.join(runs, "run_id", "left_anti")


def with_results(meta: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs (run_id, …) with the tasks they have results of; runs without results fall away."""
    return meta.join(tasks, "run_id")


def with_responses(tasks: DataFrame, responses: DataFrame) -> DataFrame:
    """tasks (run_id, task, …) with their responses (run_id, task, …); a task without responses stays, with nulls."""
    return tasks.join(responses, ["run_id", "task"], "left")


def per_task(rows: DataFrame, order: list[str]) -> DataFrame:
    """(task, runs array<struct(run_id, accuracy, f1)>) of rows (run_id, task, accuracy, f1): each task's runs in order."""
    held = F.array_sort(F.collect_list(F.struct(*order, F.struct("run_id", "accuracy", "f1").alias("r"))))
    return rows.groupBy("task").agg(F.transform(held, lambda s: s["r"]).alias("runs"))


def checkpoint_number(name: Column) -> Column:
    """The step of a folder named checkpoint-<step>, null for other names."""
    return F.regexp_extract(name, r"^checkpoint-(\d+)$", 1).try_cast("long")


def latest_checkpoint(names: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The name with the highest step (of each group), of names (name, …)."""
    rows = names.withColumn("step", checkpoint_number(F.col("name"))).where("step is not null")
    return rows.groupBy(*(group or [])).agg(F.max_by("name", F.struct("step", "name")).alias("name"), F.max("step").alias("step"))


def run_label(configs: DataFrame) -> DataFrame:
    """(run_id, label) of configs (run_id, pos, model, notes): the first with a model as "model (notes)", else notes, else unknown."""
    name = F.substring_index("model", "/", -1)
    label = F.when(F.col("model").isNotNull(), F.concat(name, F.coalesce(F.concat(F.lit(" ("), "notes", F.lit(")")), F.lit("")))).otherwise(F.col("notes"))
    return configs.groupBy("run_id").agg(F.coalesce(F.min_by(label, F.struct(F.col("model").isNull(), F.col("pos"))), F.lit("unknown")).alias("label"))
