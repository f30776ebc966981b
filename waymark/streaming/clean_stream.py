"""The cleaning job over a stream of JSON lines; the solver keeps no state, so the batch operator runs as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.operators import solver
from waymark.sources.records import LABELS


def clean(spark: SparkSession, source: str, target: str, checkpoint: str, mode: str = "definite") -> StreamingQuery:
    """Clean every file that appears in source, exactly once, until all there is has been read."""
    lines = spark.readStream.text(source).where(F.trim("value") != "")
    items = lines.select(F.col("value").alias("record"), *[F.get_json_object("value", f"$.{c}").alias(c) for c in LABELS])
    out = solver.clean(items, mode)
    return out.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
