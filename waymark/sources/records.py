"""Readers and writers of record collections."""

from __future__ import annotations

import json
import warnings
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import tasks

LABELS = ["id", "text", "oracle_option", "oracle_answer", "oracle_full_answer", "clean_note"]


def jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a non-blank line: the label fields as strings, and the whole record in `record` so that no field is lost."""
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    return lines.select(F.col("value").alias("record"), *[F.get_json_object("value", f"$.{c}").alias(c) for c in LABELS])


def write_jsonl(items: DataFrame, path: str) -> None:
    """Rows of jsonl() as lines again: other fields as they were, labels as they are now, nulls left out."""
    labels = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in LABELS]), F.array(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in LABELS])), lambda _, v: v != "{}")
    if "record" not in items.columns:
        items.write.mode("overwrite").json(path)
        return
    inner = lambda v: F.substring(v, F.lit(6), F.length(v) - 6)
    rest = F.map_filter(F.from_json("record", "map<string, string>"), lambda k, _: ~k.isin(*LABELS))
    own = F.transform(F.map_entries(labels), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), inner(e["value"])))
    others = F.transform(F.map_entries(rest), lambda e: F.concat(inner(F.to_json(F.struct(e["key"].alias("v")))), F.lit(": "), _literal(e["value"])))
    items.select(F.concat(F.lit("{"), F.array_join(F.concat(own, others), ", "), F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def _literal(v: Column) -> Column:
    """A JSON value that from_json has read as a string: numbers, booleans, objects and arrays as they are, others quoted."""
    plain = F.regexp_like(v, F.lit(r"^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|\{.*\}|\[.*\])$"))
    text = F.to_json(F.struct(v.alias("v")))
    return F.when(v.isNull(), "null").when(plain, v).otherwise(F.substring(text, F.lit(6), F.length(text) - 6))


def json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_array(rows: DataFrame, path: str) -> None:
    """rows as one JSON array, indented by two, in a single file of the folder; for results that a reader takes whole.

    Lines are laid out by the executors and written by one task as they come;
    neither the driver nor that task holds them all.
    """
    line = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false", "pretty": "true"})
    text = rows.select(F.regexp_replace(line, r"(?m)^", "  ").alias("value"))
    n = rows.count()
    if n == 0:
        text = rows.sparkSession.createDataFrame([("[]",)], "value string")
    k = F.monotonically_increasing_id()  # 0, 1, ... in the one partition
    numbered = text.coalesce(1).select("value", k.alias("k"))
    lines = numbered.select(F.concat(F.when((F.col("k") == 0) & F.lit(n > 0), "[\n").otherwise(""), "value", F.when(F.lit(n == 0), "").when(F.col("k") == n - 1, "\n]").otherwise(",")).alias("value"))
    lines.write.mode("overwrite").text(path)


def dataset(spark: SparkSession, spec: dict, split: str = "test") -> DataFrame:
    """The documents of a split of a dataset description: `dataset_kwargs.data_files.<split>` (JSON lines), or a local export, `dataset_path/<dataset_name>/<split>` in Parquet."""
    files = (spec.get("dataset_kwargs") or {}).get("data_files") or {}
    if files:
        if split not in files:
            raise ValueError(f"no files for split {split}")
        return spark.read.json(files[split])
    return spark.read.parquet("/".join(str(x) for x in (spec["dataset_path"], spec.get("dataset_name"), split) if x))


def load_config(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON configuration, from any store the cluster reaches."""
    rows = spark.read.text(path, wholetext=True).collect()  # one file
    return tasks.load(rows[0]["value"])


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths (or globs) that something is at; a warning for each other."""
    jvm, found = spark.sparkContext._jvm, []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        if there is not None and len(there):
            found.append(p)
        else:
            warnings.warn(f"nothing at {p}", stacklevel=2)
    return found


def timestamped(root: str, now: datetime | None = None) -> str:
    """A folder under root named by the time, as 20240131_235959."""
    return f"{root.rstrip('/')}/{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"


def write_run(root: str, results: DataFrame, responses: dict[str, DataFrame], config: dict | None = None) -> str:
    """A run's folder: results.json ({"results": {task: {"metric,none": value}}}), responses_<task>.jsonl and metadata.json. Returns its path."""
    spark = results.sparkSession
    metric = F.concat("metric", F.lit(",none"))
    table = results.groupBy("task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(metric, "value")))).alias("m"))
    one = table.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", F.col("m"))), lambda a, b: F.when(a["task"] < b["task"], -1).otherwise(1))).alias("results"))
    one.select(F.to_json(F.struct("results")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{root}/results.json")
    meta = json.dumps({"timestamp": datetime.now().isoformat(), "tasks": sorted(responses), **(config or {})}, ensure_ascii=False, default=str)
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/metadata.json")
    for task, rows in responses.items():
        rows.select(F.col("id").alias("doc_id"), "*").drop("id").write.mode("overwrite").json(f"{root}/responses_{task}.jsonl")
    return root


def _in(name: str) -> Column:
    """The run whose folder holds a file, or a folder of part files, of that name (a pattern)."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{name}(?:/part-[^/]*)?$", 1)


def result_files(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, json) of all root/<run>/results.json; the folder is the run."""
    rows = spark.read.text(f"{root}/*/results.json", wholetext=True)
    return rows.select(_in(r"results\.json").alias("run_id"), F.col("value").alias("json"))


def run_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, timestamp, type, model, tasks, config) of all root/<run>/metadata.json, by run_id; tasks and config as JSON text."""
    rows = spark.read.text(f"{root}/*/metadata.json", wholetext=True)
    field = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    run = F.coalesce(field("id"), _in(r"metadata\.json"))
    return rows.select(run.alias("run_id"), field("timestamp").alias("timestamp"), field("type").alias("type"), field("model", "base_model").alias("model"), field("tasks").alias("tasks"), field("config").alias("config")).orderBy("run_id")


def responses(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, task, pos, target, filtered): all root/<run>/responses_<task>.jsonl in one scan."""
    rows = spark.read.text(f"{root}/*/responses_*.jsonl").where(F.trim("value") != "")
    task = F.regexp_extract(F.col("_metadata.file_path"), r"/responses_([^/]+)\.jsonl(?:/part-[^/]*)?$", 1)
    return rows.select(_in(r"responses_[^/]+").alias("run_id"), task.alias("task"), F.get_json_object("value", "$.doc_id").cast("long").alias("pos"), F.get_json_object("value", "$.target").alias("target"), F.get_json_object("value", "$.filtered_resps").alias("filtered"))


def corpus(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, text): each file under the paths, whole; paths that don't exist are skipped. Of a .docx file its paragraphs."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "doc_id string, text string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(found).select(F.col("path").alias("doc_id"), "content")
    docx = F.lower("doc_id").endswith(".docx")
    plain = files.where(~docx).select("doc_id", F.decode("content", "UTF-8").alias("text"))
    return plain.union(files.where(docx).mapInPandas(_docx_texts, "doc_id string, text string"))


def _docx_texts(batches):  # noqa: ANN001, ANN202
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    for b in batches:
        texts = []
        for content in b["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                body = ElementTree.fromstring(z.read("word/document.xml"))
            texts.append("\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in body.iter(f"{space}p")))
        yield b[["doc_id"]].assign(text=texts)


def write_by_task(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("task").json(path)
