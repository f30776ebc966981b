"""Tables in the folder that a cluster's executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows, about, that Spark hands to a Python worker at once; a longer row comes alone.
ARROW_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder.

    Where neither is set, a session on one machine (tests) gets a temporary
    folder; on a cluster that is an error, since executors don't share one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read again: its lineage ends there, and the shuffle files it took are removed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/waymark-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLES, None)
    spark.conf.set(_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_SHUFFLES) if before is None else spark.conf.set(_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def tidy(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of queries that have ended, after steps that shuffle much: it does so when the driver's garbage is collected. The executors' is collected too."""
    spark.sparkContext._jvm.System.gc()
    shrink(spark)


def shrink(spark: SparkSession) -> None:
    """Have the executors collect their garbage: what earlier steps made a heap grow by goes back to the system, as give_back() does for workers."""
    n = spark.sparkContext.defaultParallelism  # a task a core, so each executor has some
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


_paths: dict[int, str] = {}


def forget(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing will read again."""
    for df in tables:
        path = _paths.pop(id(df), None)
        if path is not None:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _aside(columns: list[str], own: tuple[str, ...]) -> list[str]:
    number = iter(range(len(columns)))
    return [c if c in own else f"_carried_{next(number)}" for c in columns]


def set_aside(df: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list[str]]:
    """df with all columns but its own under names that clash with nothing, and those names."""
    names = _aside(df.columns, own)
    return df.toDF(*names), [c for c in names if c not in own]


def put_back(df: DataFrame, like: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns of `like` under their names again, in their order."""
    return df.select(*_aside(like.columns, own)).toDF(*like.columns)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | object) -> DataFrame:
    """df.mapInArrow(f, schema) in batches of ARROW_BYTES, a setting of the session that stays; each task gives its memory back when it ends."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) != f"{ARROW_BYTES}b":
        conf.set(name, f"{ARROW_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
