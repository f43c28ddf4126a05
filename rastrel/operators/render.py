"""Frames: both images warped to a place between them, mixed, and laid over each other layer by layer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.functions.vectors import clamp
from rastrel.operators.resample import sample

WHITE = 255.0


def halfway(field: DataFrame, img0: DataFrame, img1: DataFrame, height: int, width: int, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """(keys, y, x, v): the mean of both images where both displaced places are inside, the one that is, or white."""
    parts = []
    for k, (sign, img) in enumerate(((-1, img0), (1, img1))):
        px, py = F.col("x") + sign * F.col("vx"), F.col("y") + sign * F.col("vy")
        inside = field.where((px >= 0) & (px < width) & (py >= 0) & (py < height))
        parts.append(sample(inside, img, px, py, {f"c{k}": "v"}, height, width, keys=keys))
    on = [*keys, "y", "x"]
    both = field.select(*on).join(parts[0], on, "left").join(parts[1], on, "left")
    return both.select(*on, F.when(F.col("c0").isNotNull() & F.col("c1").isNotNull(), (F.col("c0") + F.col("c1")) / 2).otherwise(F.coalesce("c0", "c1", F.lit(WHITE))).alias("v"))


def composited(layers: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, x, v): layers (keys, y, x, z_order, v, a) over white, in their order; a of 255 is not of the layer."""
    stack = F.array_sort(F.collect_list(F.struct("z_order", "v", "a")))
    over = F.aggregate(stack, F.lit(WHITE), lambda r, s: r * s["a"] / 255.0 + s["v"] * (1.0 - s["a"] / 255.0))
    return layers.groupBy(*keys, "y", "x").agg(over.alias("v"))


BGRA = ("b", "g", "r", "a")


def zipped(one: DataFrame, other: DataFrame, columns: dict[str, str], keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """one with columns of another raster, pixel by pixel; columns: the name here by the name there."""
    return one.join(other.select(*keys, "y", "x", *(F.col(c).alias(n) for n, c in columns.items())), [*keys, "y", "x"])


def merged(image: DataFrame, mask: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, x, b, g, r, a): an image whose a is the mask's green: 255 where a pixel is not of the layer."""
    return zipped(image.select(*keys, "y", "x", "b", "g", "r"), mask, {"a": "g"}, keys)


def canvas(image: DataFrame, height: int, width: int, edge: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, x, b, g, r, a): a merged image `edge` pixels from every side of a canvas that is 255 beyond it."""
    high, wide = height + 2 * edge, width + 2 * edge
    cells = F.explode(F.sequence(F.lit(0), F.lit(high * wide - 1)))
    blank = image.select(*keys).distinct().select(*keys, cells.alias("i")).select(*keys, F.expr(f"i div {wide}").cast("int").alias("y"), (F.col("i") % wide).cast("int").alias("x"))
    moved = image.withColumns({"y": F.col("y") + edge, "x": F.col("x") + edge})
    return blank.join(moved, [*keys, "y", "x"], "left").select(*keys, "y", "x", *(F.coalesce(c, F.lit(WHITE)).alias(c) for c in BGRA))


def halfway_layers(field: DataFrame, first: DataFrame, second: DataFrame, height: int, width: int, edge: int, keys: tuple[str, ...] = ("image_id", "layer")) -> DataFrame:
    """(keys, y, x, b, g, r, a): the mean of both canvases at the places to which each layer's field points, all four
    channels, the nearest pixel beyond the canvas."""
    size = height + 2 * edge, width + 2 * edge
    parts = [
        sample(field, c, F.col("x") + sign * F.col("vx") + edge, F.col("y") + sign * F.col("vy") + edge, {f"{n}{k}": n for n in BGRA}, *size, keys=keys)
        for k, (sign, c) in enumerate(((-1, first), (1, second)))
    ]
    return parts[0].join(parts[1], [*keys, "y", "x"]).select(*keys, "y", "x", *(((F.col(f"{n}0") + F.col(f"{n}1")) / 2).alias(n) for n in BGRA))


def blended(layers: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, x, b, g, r): layers (keys, z_order, y, x, b, g, r, a) over white in their order, each by 1 - a / 255."""
    stack = F.array_sort(F.collect_list(F.struct("z_order", *BGRA)))
    white = F.struct(*(F.lit(WHITE).alias(c) for c in BGRA[:3]))

    def over(under: Column, top: Column) -> Column:
        share = 1.0 - top["a"] / 255.0
        return F.struct(*((under[c] * (1.0 - share) + top[c] * share).alias(c) for c in BGRA[:3]))

    return layers.groupBy(*keys, "y", "x").agg(F.aggregate(stack, white, over).alias("c")).select(*keys, "y", "x", "c.*")


def error_image(c: Column) -> Column:
    return clamp(c, 0.0, 1.0) * 255.0


def frame_schedule(spread: int, ticks: int) -> list[int]:
    """Percent of the way at each tick: from 50 - spread to 50 + spread and back."""
    way = list(range(50 - spread, 50 + spread + 1))
    loop = way + way[-2:0:-1] if len(way) > 1 else way
    return [loop[t % len(loop)] for t in range(ticks)]


def frame_at(tick: Column, spread: int) -> Column:
    """frame_schedule() at a tick."""
    at = F.pmod(tick, F.lit(max(1, 4 * spread)))
    return F.when(at <= 2 * spread, 50 - spread + at).otherwise(50 + 3 * spread - at)


def mask_preview(v: Column, ignore: Column, outside: Column) -> Column:
    """Half dark where ignored, white where not of the layer."""
    alpha = 1.0 - ignore / 510.0
    return F.when(outside > 0, WHITE).otherwise(v * alpha)


def layer_preview(layers: DataFrame, count: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, x, v): the uppermost layer that holds a pixel, tinted by its place in the order; white where none does."""
    top = F.max(F.when(F.col("a") == 0, F.struct("z_order", "v")))
    return layers.groupBy(*keys, "y", "x").agg(top.alias("t")).select(*keys, "y", "x", F.coalesce(F.col("t.v") * (F.col("t.z_order") + 1) / count, F.lit(WHITE)).alias("v"))


def first_pixel(df: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, x): the first pixel of the layer, in raster order, where its label goes."""
    return df.where("outside = 0").groupBy(*keys).agg(F.min(F.struct("y", "x")).alias("p")).select(*keys, "p.y", "p.x")


def picked_layer(layers: DataFrame, y: int, x: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, z_order): the first layer that holds the pixel."""
    return layers.where((F.col("y") == y) & (F.col("x") == x) & (F.col("a") == 0)).groupBy(*keys).agg(F.min("z_order").alias("z_order"))


def raised(z: Column, picked: int, by: int, count: int) -> Column:
    """The order after the picked layer changes places with the one `by` above it, kept within the stack."""
    other = min(max(picked + by, 0), count - 1)
    return F.when(z == picked, other).when(z == other, picked).otherwise(z)


def _cubic(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Catmull-Rom by 16 taps of all channels (the last axis), divided by the sum of the weights; the nearest pixel
    beyond the border."""
    taps = np.arange(-1, 3)
    y0, x0 = np.floor(y)[..., None] + taps, np.floor(x)[..., None] + taps
    w = _catmull(y[..., None] - y0)[..., :, None] * _catmull(x[..., None] - x0)[..., None, :]
    at = np.clip(y0, 0, image.shape[0] - 1).astype(int)[..., :, None], np.clip(x0, 0, image.shape[1] - 1).astype(int)[..., None, :]
    return np.einsum("yxjic,yxji->yxc", image[at], w) / w.sum((-1, -2))[..., None]


def _catmull(t: np.ndarray) -> np.ndarray:
    a = np.abs(t)
    return np.where(a < 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0.0))


def _smooth(t: float, low: float, high: float) -> float:
    u = min(max((t - low) / (high - low), 0.0), 1.0)
    return u * u * (3 - 2 * u)


def morph_frame(i0: np.ndarray, i1: np.ndarray, v: np.ndarray, u: np.ndarray, t: float, mix: str = "both", steps: int = 20) -> np.ndarray:
    """The frame at t: places follow the path p = q - (2s - 1) v - 4s(1 - s) u, found by steps of relaxation; colours are
    mixed, or of one image (first, second)."""
    s, c = _smooth(t, 0, 1), _smooth(t, 0.2, 0.8)
    y, x = (a.astype(float) for a in np.mgrid[: v.shape[0], : v.shape[1]])
    field = np.concatenate([v, u], -1)
    now, bend = field, 4 * s * (1 - s)
    for _ in range(steps):
        px, py = (q - (2 * s - 1) * now[..., k] - bend * now[..., k + 2] for k, q in enumerate((x, y)))
        now = 0.8 * _cubic(field, py, px) + 0.2 * now
    vx, vy = now[..., 0], now[..., 1]
    first, second = _cubic(i0[..., None], py - vy, px - vx)[..., 0], _cubic(i1[..., None], py + vy, px + vx)[..., 0]
    return first if mix == "first" else second if mix == "second" else first * (1 - c) + second * c


#: Frames of a pair that a task makes from one copy of its pixels.
FRAMES = 8


def morph_frames(pairs: DataFrame, times: list[float], mix: str = "both") -> DataFrame:
    """(pair_id, frame, y, x, v) of pairs (pair_id, y, x, v0, v1, vx, vy, ux, uy): pairs, and frames by eight, run in parallel."""
    work = pairs.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit((len(times) - 1) // FRAMES))))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        shape = (int(part["y"].max()) + 1, int(part["x"].max()) + 1)
        a = {c: np.zeros(shape) for c in ("v0", "v1", "vx", "vy", "ux", "uy")}
        for c, image in a.items():
            image[part["y"], part["x"]] = part[c]
        v, u = np.stack([a["vx"], a["vy"]], -1), np.stack([a["ux"], a["uy"]], -1)
        y, x = (c.ravel() for c in np.mgrid[: shape[0], : shape[1]])
        own = range(FRAMES * key[1], min(len(times), FRAMES * (key[1] + 1)))
        return pd.concat([pd.DataFrame({"pair_id": key[0], "frame": k, "y": y, "x": x, "v": morph_frame(a["v0"], a["v1"], v, u, times[k], mix).ravel()}) for k in own])

    return work.groupBy("pair_id", "__part").applyInPandas(run, "pair_id long, frame int, y int, x int, v double")
