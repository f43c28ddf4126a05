"""Pyramids in linear light: bytes are loaded through the sRGB curve, each level is made from the one before and stored as
bytes again. Every level is written once, and read both as a result and as the source of the next."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.functions.composed import Composed, interpolating
from rastrel.functions.pixels import linear_to_srgb, srgb_to_linear
from rastrel.functions.vectors import clamp
from rastrel.operators.lines import reconstructed
from rastrel.operators.resample import level_sizes
from rastrel.tables import Written

KEYS = ("image_id",)
RGB = ("r", "g", "b")
# Weights of red, green and blue in 2^14 parts, and a half.
_GRAY, _HALF, _WHOLE = (4899, 9617, 1868), 8192, 16384


def loaded(c: Column) -> Column:
    """Linear light of a byte."""
    return srgb_to_linear(c / 255.0)


def stored(c: Column) -> Column:
    """The byte of linear light: within 0..1, through the curve, cut off to a whole number."""
    return F.floor(255.0 * linear_to_srgb(clamp(c, 0.0, 1.0))).cast("int")


def gray(r: Column, g: Column, b: Column) -> Column:
    """The gray byte of bytes."""
    return F.floor((_GRAY[0] * r + _GRAY[1] * g + _GRAY[2] * b + _HALF) / _WHOLE).cast("int")


def _by_channel(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in RGB)))
    return df.select(*keys, "y", "x", cells.alias("c")).select(*keys, "c.channel", "y", "x", "c.v")


def _together(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys, "y", "x").agg(*(F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in RGB))


def resized(df: DataFrame, height: int, width: int, to_height: int, to_width: int, k: Composed, keys: tuple[str, ...] = KEYS, gamma: bool = True) -> DataFrame:
    """(keys, y, x, r, g, b): linear light at another size (see lines.reconstructed), all channels in one pass."""
    return _together(reconstructed(_by_channel(df, keys), height, width, to_height, to_width, k, gamma=gamma, keys=(*keys, "channel")), keys)


def _levels(light: DataFrame, sizes: list[tuple[int, int]], k: Composed, keys: tuple[str, ...]) -> Iterator[DataFrame]:
    """Linear light of the levels after the first, each written once."""
    keep, now = Written(light.sparkSession, "pyramid"), light
    for before, after in zip(sizes, sizes[1:]):
        now = keep.put(resized(now, *before, *after, k, keys))
        yield now


def _told(df: DataFrame, level: int, keys: tuple[str, ...]) -> DataFrame:
    return df.select(*keys, F.lit(level).alias("level"), "y", "x", *RGB, gray(*map(F.col, RGB)).alias("gray"))


def light_levels(df: DataFrame, height: int, width: int, start_res: int = 8, kernel: str = "bspline3", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, level, y, x, r, g, b) in linear light, from the second level on. df: bytes (keys, y, x, r, g, b), and where
    it has `ignore` and `outside`, pixels that are not of the layer and not merely ignored are white before they are made
    smaller."""
    masked = {"ignore", "outside"} <= set(df.columns)
    white = (F.col("ignore") == 0) & (F.col("outside") > 0) if masked else F.lit(False)
    light = df.select(*keys, "y", "x", *(F.when(white, 1.0).otherwise(loaded(F.col(c))).alias(c) for c in RGB))
    out = None
    for level, made in enumerate(_levels(light, level_sizes(height, width, start_res), interpolating(kernel), keys), 1):
        own = made.select(*keys, F.lit(level).alias("level"), "y", "x", *RGB)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else light.select(*keys, F.lit(0).alias("level"), "y", "x", *RGB).where("false")


def byte_levels(df: DataFrame, height: int, width: int, start_res: int = 8, kernel: str = "bspline3", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, level, y, x, r, g, b, gray) in bytes: the images themselves and all smaller levels, halved and cut off."""
    small = light_levels(df, height, width, start_res, kernel, keys)
    small = small.withColumns({c: stored(F.col(c)) for c in RGB})
    first = df.select(*keys, "y", "x", *(F.col(c).cast("int").alias(c) for c in RGB))
    return _told(first, 0, keys).unionByName(small.select(*keys, "level", "y", "x", *RGB, gray(*map(F.col, RGB)).alias("gray")))


def halvings(df: DataFrame, height: int, width: int, kernel: str = "bspline3", keys: tuple[str, ...] = KEYS) -> Iterator[tuple[int, int, DataFrame]]:
    """(height, width, bytes) of images halved, rounding up, until a side is 8 or less; each made when it is asked for."""
    sizes = [(height, width)]
    while min(sizes[-1]) > 8:
        sizes.append(tuple(-(-n // 2) for n in sizes[-1]))  # type: ignore[arg-type]
    light = df.select(*keys, "y", "x", *(loaded(F.col(c)).alias(c) for c in RGB))
    for size, made in zip(sizes[1:], _levels(light, sizes, interpolating(kernel), keys)):
        yield *size, made.select(*keys, "y", "x", *(stored(F.col(c)).alias(c) for c in RGB))
