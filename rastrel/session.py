"""A session with the settings that raster plans want; anything may be overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "rastrel", **config: str) -> SparkSession:
    """Adaptive execution with skewed joins split, and UTC, so that days and hours are the same everywhere."""
    wanted = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"} | {
        k.replace("__", "."): v for k, v in config.items()
    }
    return SparkSession.builder.appName(app).config(map=wanted).getOrCreate()
