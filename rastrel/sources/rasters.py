"""Rasters read from tables: dense relations (image_id, y, x, v), one row for each pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_arrays(df: DataFrame, keys: list[str], values: str, width: int) -> DataFrame:
    """(keys, y, x, e): the cells of each row's array, row-major. Rows are dealt out by their keys while they are still
    arrays, so that windows over the pixels need no exchange (see neighbourhood.box, arranged)."""
    cells = df.repartition(*keys).select(*keys, F.posexplode(values).alias("i", "e"))
    return cells.select(*keys, F.expr(f"i div {width}").cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "e")


def _bytes(c: Column) -> Column:
    return (c.cast("double") + 1) * 127.5


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 by 8 image of bytes' range from each embedding; arranged."""
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    return from_arrays(df, ["image_id"], "embedding", 8).select("image_id", "y", "x", _bytes(F.col("e")).alias("v"))


def _together(spark: SparkSession, sf_dir: str, key: str, count: int) -> DataFrame:
    """(key, y, x, e): vectors count * k and so on side by side, e.v0, e.v1, ... by cell; arranged. The vectors meet
    before they become pixels, and incomplete groups are left out."""
    df = table(spark, sf_dir, "embeddings")
    own = [F.max(F.when(F.col("vec_id") % count == k, F.col("embedding"))).alias(f"v{k}") for k in range(count)]
    groups = df.groupBy(F.expr(f"vec_id div {count}").alias(key)).agg(*own).dropna(subset=[f"v{k}" for k in range(count)])
    cells = groups.select(key, F.posexplode(F.arrays_zip(*(f"v{k}" for k in range(count)))).alias("i", "e"))
    return cells.select(key, F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), "e")


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images 2k and 2k+1 side by side: (pair_id, y, x, v0, v1); arranged."""
    return _together(spark, sf_dir, "pair_id", 2).select("pair_id", "y", "x", *(_bytes(F.col(f"e.v{k}")).alias(f"v{k}") for k in range(2)))


def embedding_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 3k, 3k+1 and 3k+2 as the channels of an image in 0..1: (image_id, y, x, r, g, b); arranged."""
    unit = [F.least(F.greatest(F.col(f"e.v{k}").cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)).alias(c) for k, c in enumerate("rgb")]
    return _together(spark, sf_dir, "image_id", 3).select("image_id", "y", "x", *unit)


def grid(df: DataFrame, image_id: str, height: int, width: int) -> DataFrame:
    """All pixels of the images that df names."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(height * width - 1)))
    ids = df.select(image_id).distinct().select(F.col(image_id).alias("image_id"), cells.alias("i"))
    return ids.select("image_id", F.expr(f"i div {width}").cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"))


def densified(sums: DataFrame, height: int, width: int, fill: float = 0.0) -> DataFrame:
    """(image_id, y, x, v) with a row for each pixel: what sums lacks is filled. Images are few, pixels many."""
    return grid(sums, "image_id", height, width).join(sums, ["image_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and hour, an image of 30 by 24 for each type."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("image_id"), (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x"))
    return densified(rows.groupBy("image_id", "y", "x").agg(F.count(F.lit(1)).cast("double").alias("v")), 30, 24)


def lineitem_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by quantity and discount, an image of 50 by 11 for each flag and status."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("image_id"), (F.col("l_quantity").cast("int") - 1).alias("y"),
        F.round(F.col("l_discount") * 100).cast("int").alias("x"), F.col("l_extendedprice").alias("p"),
    )
    return densified(rows.groupBy("image_id", "y", "x").agg(F.sum("p").alias("v")), 50, 11)


def synthetic_field(df: DataFrame) -> DataFrame:
    """df with halfway vectors vx and vy, quarters from -3/4 to 3/4, which any engine holds exactly."""
    return df.withColumns({"vx": ((3 * F.col("x") + 5 * F.col("y")) % 7 - 3) / F.lit(4.0), "vy": ((5 * F.col("x") + 3 * F.col("y")) % 7 - 3) / F.lit(4.0)})


#: Control points of every pair, normalised: (idx, lx, ly, rx, ry); one in a corner, one on a pixel's centre.
CONTROL_POINTS = ((0, 0.25, 0.3, 0.4, 0.35), (1, 0.0625, 0.0625, 0.0625, 0.0625), (2, 0.5625, 0.6875, 0.6875, 0.5625))


def control_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONTROL_POINTS), "idx int, lx double, ly double, rx double, ry double")


def synthetic_masks(df: DataFrame) -> DataFrame:
    """df with ignore (255 = left out of similarity) and outside (255 = not of the layer), by position."""
    return df.withColumns({"ignore": F.when((F.col("x") + F.col("y")) % 5 == 0, 255.0).otherwise(0.0), "outside": F.when(F.col("x") < 2, 255.0).otherwise(0.0)})
