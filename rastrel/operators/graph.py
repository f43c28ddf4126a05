"""Contours: link costs between pixels, shortest paths inside a window of the seed, and polygons as masks."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.operators.neighbourhood import neighbours

KEYS = ("image_id",)
#: Directions 0 to 7, counter-clockwise from the east, as (dy, dx).
DIRECTIONS = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
#: By direction: neighbours that are added and taken away, and the divisor.
_LINKS = (((2, 1), (6, 7), 4.0), ((0,), (2,), math.sqrt(2)), ((3, 4), (0, 1), 4.0), ((4,), (2,), math.sqrt(2)), ((2, 3), (6, 5), 4.0), ((4,), (6,), math.sqrt(2)), ((4, 5), (0, 7), 4.0), ((0,), (6,), math.sqrt(2)))
RADIUS = 50


def edge_costs(df: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, y, x, dir, link): the colour gradient across each of a pixel's eight links; 0 on the border."""
    wanted = {f"__{c}{d}": (c, dy, dx) for d, (dy, dx) in enumerate(DIRECTIONS) for c in channels}
    wide = neighbours(df, wanted, keys)

    def link(d: int) -> Column:
        plus, minus, by = _LINKS[d]
        squares = F.lit(0.0)
        for c in channels:
            diff = F.lit(0.0)
            for k in plus:
                diff = diff + F.col(f"__{c}{k}")
            for k in minus:
                diff = diff - F.col(f"__{c}{k}")
            squares = squares + (diff / by) * (diff / by)
        return F.struct(F.lit(d).alias("dir"), F.coalesce(F.sqrt(squares), F.lit(0.0)).alias("link"))

    inside = F.lit(True)
    for c in channels:
        for d in range(8):
            inside &= F.col(f"__{c}{d}").isNotNull()
    links = F.explode(F.array(*(F.when(inside, link(d)).otherwise(F.struct(F.lit(d).alias("dir"), F.lit(0.0).alias("link"))) for d in range(8))))
    return wide.select(*keys, "y", "x", links.alias("l")).select(*keys, "y", "x", "l.dir", "l.link")


def inverted(links: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """links with cost: what a link lacks to the image's strongest, times its length."""
    top = links.groupBy(*keys).agg(F.max("link").alias("__top"))
    length = F.when(F.col("dir") % 2 == 0, 1.0).otherwise(math.sqrt(2))
    return links.join(top, list(keys)).withColumn("cost", (F.col("__top") - F.col("link")) * length).drop("__top")


def neighbour_list(links: DataFrame, height: int, width: int) -> DataFrame:
    """links with ny and nx, the pixel a link leads to; links out of the image are left out."""
    dy, dx = (F.array(*(F.lit(d[k]) for d in DIRECTIONS)) for k in (0, 1))
    to = links.withColumns({"ny": F.col("y") + F.get(dy, F.col("dir")), "nx": F.col("x") + F.get(dx, F.col("dir"))})
    return to.where(f"ny between 0 and {height - 1} and nx between 0 and {width - 1}")


def shortest_paths(cost: np.ndarray, seed: tuple[int, int], radius: int = RADIUS) -> tuple[np.ndarray, dict]:
    """(distance, predecessor) from the seed inside its window; cost is (height, width, 8), inf outside."""
    high, wide, _ = cost.shape
    far = np.full((high, wide), np.inf)
    far[seed], before, heap = 0.0, {}, [(0.0, seed)]
    while heap:
        d, (y, x) = heapq.heappop(heap)
        if d > far[y, x]:
            continue
        for k, (dy, dx) in enumerate(DIRECTIONS):
            ny, nx = y + dy, x + dx
            if 0 <= ny < high and 0 <= nx < wide and abs(ny - seed[0]) <= radius and abs(nx - seed[1]) <= radius and d + cost[y, x, k] < far[ny, nx]:
                far[ny, nx], before[ny, nx] = d + cost[y, x, k], (y, x)
                heapq.heappush(heap, (far[ny, nx], (ny, nx)))
    return far, before


def livewire(costs: DataFrame, seed: tuple[int, int], target: tuple[int, int], radius: int = RADIUS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, step, y, x, distance): the cheapest path from the seed to the target, which is brought into the window.

    costs has a row for each pixel and link. Images run in parallel; only the window of each comes to its task.
    """
    near = costs.where(F.col("y").between(seed[0] - radius, seed[0] + radius) & F.col("x").between(seed[1] - radius, seed[1] + radius))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in costs.select(*keys).schema) + ", step int, y int, x int, distance double"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        high, wide = int(part["y"].max()) + 1, int(part["x"].max()) + 1
        cost = np.full((high, wide, 8), np.inf)
        cost[part["y"], part["x"], part["dir"]] = part["cost"]
        far, before = shortest_paths(cost, seed, radius)
        at = (min(max(target[0], int(part["y"].min())), high - 1), min(max(target[1], int(part["x"].min())), wide - 1))
        path = [at]
        while path[-1] in before:
            path.append(before[path[-1]])
        path.reverse()
        rows = [(*key, i, y, x, far[y, x]) for i, (y, x) in enumerate(path)] if path[0] == seed else []
        return pd.DataFrame(rows, columns=[*keys, "step", "y", "x", "distance"])

    return near.groupBy(*keys).applyInPandas(run, schema)


def inside_polygons(df: DataFrame, polygons: dict[int, list[tuple[float, float]]]) -> DataFrame:
    """df with polygon ids (array) that hold the pixel's centre: an odd number of edges crossed to its right.

    Polygons are drawn by hand, few and short, so their edges are literals of the plan.
    """
    inside = []
    for number, corners in sorted(polygons.items()):
        crossed = F.lit(0)
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            if ay == by:
                continue
            meets = (F.lit(float(min(ay, by))) <= F.col("y")) & (F.col("y") < F.lit(float(max(ay, by))))
            at = F.lit(float(ax)) + (F.col("y") - float(ay)) * ((bx - ax) / (by - ay))
            crossed = crossed + F.when(meets & (F.col("x") < at), 1).otherwise(0)
        inside.append(F.when(crossed % 2 == 1, F.lit(number)))
    return df.withColumn("polygons", F.array_compact(F.array(*inside)))


def polygon_masks(df: DataFrame, polygons: dict[int, list[tuple[float, float]]]) -> DataFrame:
    """df with the masks that a drawing leaves: ignore, and the outside of the parent and of the new layer."""
    held = F.size("polygons") > 0
    return inside_polygons(df, polygons).withColumns({
        "ignore": F.when(held, 255).otherwise(0), "parent_outside": F.when(held, 255).otherwise(0), "new_outside": F.when(held, 0).otherwise(255),
    })


def thinned(contour: list[tuple[float, float]], step: int = 3, most: int = 200) -> list[tuple[float, float]]:
    """Every third point of a contour, as far as a polygon has room."""
    return contour[::step][:most]
