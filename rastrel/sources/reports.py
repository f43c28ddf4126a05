"""Text reports: fields line by line, and how long stages and levels took."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_field(field: DataFrame, path: str) -> None:
    """A line `vx vy` for each pixel, row by row: ranges of rows are sorted and written apart, and their files in the
    order of their names are the whole text."""
    lines = field.select("y", "x", F.format_string("%.6f %.6f", "vx", "vy").alias("value"))
    lines.repartitionByRange("y").sortWithinPartitions("y", "x").select("value").write.text(path)


class Metrics:
    """Times stages, nested ones under their own; told as a table."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, float, int]] = []
        self._open: list[str] = []

    @contextmanager
    def stage(self, label: str, size: int = 0) -> Iterator[None]:
        """size: how many units the stage handles, for a rate."""
        self._open.append(label)
        began = time.perf_counter()
        try:
            yield
        finally:
            name = "/".join(self._open)
            self._open.pop()
            self.rows.append((name, "/".join(self._open), time.perf_counter() - began, size))

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, parent, runs, sec, percent of the parent, per_sec)."""
        df = spark.createDataFrame(self.rows or [], "stage string, parent string, sec double, size long")
        sums = df.groupBy("stage", "parent").agg(F.count(F.lit(1)).alias("runs"), F.sum("sec").alias("sec"), F.sum("size").alias("size"))
        whole = sums.select(F.col("stage").alias("parent"), F.col("sec").alias("whole"))
        share = 100 * F.col("sec") / F.nullif(F.coalesce("whole", "sec"), F.lit(0.0))
        return sums.join(whole, "parent", "left").select("stage", "parent", "runs", "sec", share.alias("percent"), (F.col("size") / F.nullif(F.col("sec"), F.lit(0.0))).alias("per_sec"))


def rate(value: float) -> str:
    """A rate with its unit's prefix."""
    for prefix, unit in (("T", 1e12), ("G", 1e9), ("M", 1e6), ("k", 1e3)):
        if value >= unit:
            return f"{value / unit:.2f} {prefix}"
    return f"{value:.2f} "
