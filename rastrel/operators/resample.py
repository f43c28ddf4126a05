"""Samplers at computed places, cell averages and pyramids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.functions.filters import sampled
from rastrel.functions.kernels import Kernel, kernel
from rastrel.operators.lines import along, resized, scale

KEYS = ("image_id",)


#: Side of the squares in which places and pixels meet.
SQUARE = 64
#: Points of which the taps are looked up at once.
CHUNK = 1 << 17


def sample(
    points: DataFrame, raster: DataFrame, px: Column, py: Column, values: dict[str, str], height: int, width: int, k: str = "hat", border: str = "clamp",
    fill: float = 255.0, keys: tuple[str, ...] = KEYS, normalise: bool = False, order: tuple[int, int] = (0, 0),
) -> DataFrame:
    """(keys, y, x, values) of a raster sampled at (px, py) of each point (keys, y, x).

    border: clamp takes the nearest pixel, fill a value. order asks for derivatives in x and y, for kernels that have
    them. values names the raster's columns to read. A null pixel, and with fill a missing one, counts as the fill; points
    without a place, or in an image that there is not, have no row, but for fill, where such an image is all fill.

    The four taps of a kernel of two are joined with pixels, in the JVM; the sixteen and more of others would be as many
    rows a point, so their points and pixels meet by squares.
    """
    dx, dy = (kernel("d" * o + ("-" if o else "") + k) for o in order)
    way = _by_taps if kernel(k).support <= 2 else _by_squares
    return way(points, raster, px, py, values, height, width, math.ceil(kernel(k).support / 2), (dx, dy), border, fill, keys, normalise)


def _by_taps(
    points: DataFrame, raster: DataFrame, px: Column, py: Column, values: dict[str, str], height: int, width: int, reach: int, used: tuple[Kernel, Kernel], border: str,
    fill: float, keys: tuple[str, ...], normalise: bool,
) -> DataFrame:
    """sample() by an equi-join of each point's taps with the raster on their integer places, and a sum by point."""
    dx, dy = used

    def taps(p: Column, by: Kernel, name: str) -> Column:
        low = F.floor(p).cast("int")
        return F.array(*(F.struct((low + j).alias(name), by.value(p - (low + j)).alias("w")) for j in range(1 - reach, reach + 1)))

    at = points.select(*keys, "y", "x", px.alias("__px"), py.alias("__py"))
    at = at.withColumn("__ty", F.explode(taps(F.col("__py"), dy, "t"))).withColumn("__tx", F.explode(taps(F.col("__px"), dx, "t")))
    weight = F.col("__ty.w") * F.col("__tx.w")
    place = {c: F.col(f"__t{c}.t") for c in "xy"}
    if border == "clamp":
        place = {c: F.least(F.greatest(t, F.lit(0)), F.lit((width if c == "x" else height) - 1)) for c, t in place.items()}
    at = at.select(*keys, "y", "x", weight.alias("__w"), place["y"].alias("__y"), place["x"].alias("__x")).where("__w <> 0")
    there = raster.select(*(F.col(c).alias(f"__{c}") for c in (*keys, "y", "x")), *(F.col(c).alias(f"__v_{n}") for n, c in values.items()))
    on = [at[c] == there[f"__{c}"] for c in keys] + [at["__y"] == there["__y"], at["__x"] == there["__x"]]
    joined = at.join(there, on, "inner" if border == "clamp" else "left")
    total = {n: F.sum(F.col("__w") * F.coalesce(F.col(f"__v_{n}"), F.lit(fill))) for n in values}
    if normalise:
        total = {n: t / F.nullif(F.sum("__w"), F.lit(0.0)) for n, t in total.items()}
    return joined.groupBy(*(at[c] for c in (*keys, "y", "x"))).agg(*(t.alias(n) for n, t in total.items()))


def _by_squares(
    points: DataFrame, raster: DataFrame, px: Column, py: Column, values: dict[str, str], height: int, width: int, reach: int, used: tuple[Kernel, Kernel], border: str,
    fill: float, keys: tuple[str, ...], normalise: bool,
) -> DataFrame:
    """sample() by squares of points that meet squares of pixels: a square of points asks for each square of pixels that its
    taps touch, in a row of its own, so what meets in a row is bounded by both, wherever the points lead; the parts of a
    point, from up to four squares, are summed. Points with a null key have no row."""
    (dx, dy), clamped, sources = used, border == "clamp", list(dict.fromkeys(values.values()))
    own = {f.name: f.dataType.simpleString() for f in points.select(*keys).schema}

    def squares(df: DataFrame, prefix: str, columns: dict[str, Column]) -> DataFrame:
        number = [F.floor(F.col(c) / SQUARE).cast("int").alias(f"{prefix}{c}") for c in "yx"]
        found = df.select(*keys, *number, *(c.cast("double").alias(n) for n, c in columns.items())).dropna(subset=list(keys))
        return found.groupBy(*keys, f"{prefix}y", f"{prefix}x").agg(*(F.collect_list(n).alias(n) for n in columns))

    def taps(p: np.ndarray, by: Kernel, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(pixels, weights), by point and tap."""
        to = np.floor(p)[:, None] + np.arange(1 - reach, reach + 1)
        weight = by.at(p[:, None] - to)
        return (np.clip(to, 0, size - 1) if clamped else np.clip(to, -1, size)).astype(np.int64), weight

    def chunks(batches: Iterator[pd.DataFrame], each: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        """(some rows, their points' rows, their points: y, x, px, py): CHUNK points at a time, a row counting `each` at least."""
        for batch in batches:
            sizes = batch["__y"].map(len).to_numpy()
            cost = np.cumsum(sizes + each) // CHUNK
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(cost)) + 1) if len(batch) else ():
                some = batch.iloc[part]
                yield some, np.repeat(np.arange(len(part)), sizes[part]), np.stack([np.concatenate(list(some[c])) for c in ("__y", "__x", "__px", "__py")])

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each square of pixels that a square of points reaches."""
        tall, wide = height // SQUARE + 3, width // SQUARE + 3
        for some, row, places in chunks(batches, 1):
            n = len(row)
            ty, tx = taps(places[3], dy, height)[0] // SQUARE + 1, taps(places[2], dx, width)[0] // SQUARE + 1
            found = np.unique(np.concatenate([((row * tall + a) * wide + c) * n + np.arange(n) for a in (ty[:, 0], ty[:, -1]) for c in (tx[:, 0], tx[:, -1])]))
            number, point = np.divmod(found, n)
            bounds = np.flatnonzero(np.diff(number)) + 1
            first = number[np.concatenate(([0], bounds))]
            out = some[list(own)].iloc[first // (tall * wide)].reset_index(drop=True)
            out["__sy"], out["__sx"] = first // wide % tall - 1, first % wide - 1
            for name, a in zip(("__y", "__x", "__px", "__py"), places[:, point]):
                out[name] = pd.Series(np.split(a, bounds), dtype=object)
            yield out

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a square of pixels gives to each of its points: the sum of its weights, and of weights times values."""
        tall, wide = min(SQUARE, height + 1), min(SQUARE, width + 1)  # one more than there is stands for what is beyond
        for some, row, (y, x, qx, qy) in chunks(batches, tall * wide * len(sources)):
            sy, sx = (some[c].to_numpy() for c in ("__sy", "__sx"))
            image, there = np.full((len(sources), len(some), tall, wide), fill), np.zeros((len(some), tall, wide), bool)
            held = some[some["__there_y"].notna()]
            if len(held):
                of = np.repeat(np.flatnonzero(some["__there_y"].notna()), held["__there_y"].map(len))
                at = (of, *(np.concatenate(list(held[f"__there_{c}"])).astype(int) - s[of] * SQUARE for c, s in (("y", sy), ("x", sx))))
                there[at] = True
                for k, a in enumerate(image):
                    a[at] = np.concatenate(list(held[f"__v_{k}"]))
            (ty, wy), (tx, wx) = taps(qy, dy, height), taps(qx, dx, width)
            wy, wx = np.where(ty // SQUARE == sy[row, None], wy, 0.0), np.where(tx // SQUARE == sx[row, None], wx, 0.0)
            weight = wy[:, :, None] * wx[:, None, :]
            cell = (row[:, None, None], np.minimum(ty % SQUARE, tall - 1)[:, :, None], np.minimum(tx % SQUARE, wide - 1)[:, None, :])
            if clamped:
                weight = np.where(there[cell], weight, 0.0)
            reached = np.flatnonzero(weight.any((1, 2)))
            out = some[list(own)].iloc[row[reached]].reset_index(drop=True)
            out["y"], out["x"], out["__w"] = y[reached].astype(np.int64), x[reached].astype(np.int64), weight.sum((1, 2))[reached]
            for k, a in enumerate(image):
                out[f"__of_{k}"] = np.where(weight != 0, weight * a[cell], 0.0).sum((1, 2))[reached]
            yield out

    told = "".join(f"`{n}` {t}, " for n, t in own.items())
    place = points.select(*keys, "y", "x", px.alias("__px"), py.alias("__py")).dropna(subset=["y", "x", "__px", "__py"])
    wanted = squares(place, "__t", {"__y": F.col("y"), "__x": F.col("x"), "__px": F.col("__px"), "__py": F.col("__py")}).drop("__ty", "__tx")
    wanted = wanted.mapInPandas(asked, told + "__sy int, __sx int, __y array<double>, __x array<double>, __px array<double>, __py array<double>")
    inside = raster.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    pixels = squares(inside, "__s", {"__there_y": F.col("y"), "__there_x": F.col("x")} | {f"__v_{k}": F.coalesce(c, F.lit(fill)) for k, c in enumerate(sources)})
    met = wanted.join(pixels, [*keys, "__sy", "__sx"], "inner" if clamped else "left")
    parts = met.mapInPandas(summed, told + "y long, x long, __w double" + "".join(f", __of_{k} double" for k in range(len(sources))))
    total = {n: F.sum(f"__of_{sources.index(c)}") for n, c in values.items()}
    if normalise:
        total = {n: t / F.nullif(F.sum("__w"), F.lit(0.0)) for n, t in total.items()}
    kinds = {c: points.schema[c].dataType for c in "yx"}
    return parts.groupBy(*keys, *(F.col(c).cast(kinds[c]).alias(c) for c in "yx")).agg(*(t.alias(n) for n, t in total.items()))


def warp(field: DataFrame, raster: DataFrame, sign: int, height: int, width: int, keys: tuple[str, ...] = KEYS, **how) -> DataFrame:
    """The raster at q + sign v(q) for each pixel q of the field (keys, y, x, vx, vy)."""
    return sample(field, raster, F.col("x") + sign * F.col("vx"), F.col("y") + sign * F.col("vy"), {"v": "v"}, height, width, keys=keys, **how)


def upsample(df: DataFrame, height: int, width: int, to_height: int, to_width: int, k: str = "hat", mode: str = "clamp", value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Values at (i + 1/2) n / m - 1/2 along each axis, by the kernel."""
    pick = kernel(k)
    wide = along(df, "x", lambda line: resized(line, to_width, pick, mode, normalise=False), value, keys)
    return along(wide, "y", lambda line: resized(line, to_height, pick, mode, normalise=False), value, keys)


def upsample_field(field: DataFrame, height: int, width: int, to_height: int, to_width: int, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """A field at another size: bilinear, and each component longer by its axis's ratio."""
    out = None
    for c, ratio in (("vx", to_width / width), ("vy", to_height / height)):
        part = upsample(field.select(*keys, "y", "x", (F.col(c) * ratio).alias(c)), height, width, to_height, to_width, value=c, keys=keys)
        out = part if out is None else out.join(part, [*keys, "y", "x"])
    return out  # type: ignore[return-value]


def area_average(df: DataFrame, factor: int, value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Means of square cells: a combining aggregation by cell."""
    cell = [F.expr(f"{c} div {factor}").alias(c) for c in "yx"]
    return df.groupBy(*keys, *cell).agg(F.avg(value).alias(value))


def downsample_cells(df: DataFrame, height: int, width: int, to_height: int, to_width: int, k: str = "bspline3", value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each pixel adds to the cells in its reach: sums of weight times value and of weights meet by cell, and divide."""
    pick = kernel(k)
    spread = df
    for c, n, m in (("y", height, to_height), ("x", width, to_width)):
        step = n / m
        centre = (F.col(c) + 0.5) / step - 0.5
        reach = F.sequence(F.ceil(centre - pick.support / 2).cast("int"), F.floor(centre + pick.support / 2).cast("int"))
        spread = spread.withColumn(f"__{c}", F.explode(reach)).where(f"__{c} between 0 and {m - 1}").withColumn(f"__w{c}", pick.value(F.col(f"__{c}") - centre))
    w = F.col("__wy") * F.col("__wx")
    return spread.groupBy(*keys, F.col("__y").alias("y"), F.col("__x").alias("x")).agg((F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0.0))).alias(value))


def level_count(height: int, width: int, start_res: int = 8) -> int:
    """Levels of a pyramid whose coarsest has a shorter side of start_res to twice that; one at least."""
    return max(1, math.floor(math.log2(min(height, width)) - math.log2(start_res)) + 1)


def levels_of(height: Column, width: Column, start_res: int = 8) -> Column:
    """level_count() of sizes in whole numbers: as many as the shorter side has bits over start_res; one at least."""
    return F.greatest(F.lit(1), F.length(F.bin(F.floor(F.least(height, width) / start_res).cast("long"))))


def level_sizes(height: int, width: int, start_res: int = 8, variant: str = "cpu") -> list[tuple[int, int]]:
    """(height, width) by level: halved and cut off each time, or (gpu) the first by powers of two, rounded."""
    sizes = [(height, width)]
    for level in range(1, level_count(height, width, start_res)):
        h, w = sizes[-1]
        sizes.append((h // 2, w // 2) if variant == "cpu" else (math.floor(height / 2**level + 0.5), math.floor(width / 2**level + 0.5)))
    return sizes


def build_pyramid(df: DataFrame, height: int, width: int, start_res: int = 8, variant: str = "cpu", value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, level, y, x, value): each level from the one before (cpu) or from the first (gpu), by cardinal cubic B-splines."""
    sizes = level_sizes(height, width, start_res, variant)
    out = now = df.select(*keys, "y", "x", value)
    out = out.withColumn("level", F.lit(0))
    for level in range(1, len(sizes)):
        source, size = (now, sizes[level - 1]) if variant == "cpu" else (df.select(*keys, "y", "x", value), sizes[0])
        now = scale(source, *size, *sizes[level], "bspline3", inverse_taps=sampled("bspline3"), value=value, keys=keys)
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out.select(*keys, "level", "y", "x", value)


def halved(df: DataFrame, height: int, width: int, value: str = "v", keys: tuple[str, ...] = KEYS) -> list[tuple[int, int, DataFrame]]:
    """(height, width, image) halved, rounding up, until a side is 8 or less."""
    out = []
    while min(height, width) > 8:
        h, w = -(-height // 2), -(-width // 2)
        df = scale(df, height, width, h, w, "bspline3", inverse_taps=sampled("bspline3"), value=value, keys=keys)
        height, width = h, w
        out.append((h, w, df))
    return out


def white_out(df: DataFrame, value: str = "v", white: float = 1.0) -> DataFrame:
    """Pixels that are not of the layer, and not merely ignored, become white, as before a level is made smaller."""
    return df.withColumn(value, F.when((F.col("ignore") == 0) & (F.col("outside") > 0), white).otherwise(F.col(value)))
