"""Rasters that grow with a stream of events, and long jobs that can be watched and stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def density(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(image_id, window, y, x, v): events by type, day and hour as they come; an hour is closed once it is `late` behind."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    hours = stamped.withWatermark("ts", late).groupBy(F.col("event_type").alias("image_id"), F.window("ts", "1 hour").alias("window"))
    return hours.agg(F.count(F.lit(1)).cast("double").alias("v")).select(
        "image_id", "window", (F.dayofmonth("window.start") - 1).alias("y"), F.hour("window.start").alias("x"), "v"
    )


def to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed hours appended to a Parquet table, once each, for as much input as there is now."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def stoppable(spark: SparkSession, name: str) -> Iterator[Callable[[], None]]:
    """Jobs started inside are of one group; what this gives stops them."""
    context = spark.sparkContext
    context.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield lambda: context.cancelJobGroup(name)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)  # type: ignore[arg-type]
