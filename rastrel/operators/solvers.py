"""Linear systems: the coarsest field, and the motion path that bends from one image to the other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.operators.neighbourhood import neighbours, thin_plate_matrix

KEYS = ("pair_id",)
LOCK = 10.0


def point_terms(points: list[tuple[float, float, float, float]], height: int, width: int) -> list[tuple[int, int, float, float, float]]:
    """(y, x, weight, tx, ty) of each pixel that a control point (lx, ly, rx, ry) reaches."""
    out = []
    for lx, ly, rx, ry in points:
        x0, x1, y0, y1 = lx * width - 0.5, rx * width - 0.5, ly * height - 0.5, ry * height - 0.5
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        for y in range(int(np.floor(cy)), int(np.ceil(cy)) + 1):
            for x in range(int(np.floor(cx)), int(np.ceil(cx)) + 1):
                if 0 <= y < height and 0 <= x < width:
                    out.append((y, x, (1 - abs(y - cy)) * (1 - abs(x - cx)), (x1 - x0) / 2, (y1 - y0) / 2))
    return out


def locked_mask(height: int, width: int, mode: str) -> np.ndarray:
    out = np.zeros((height, width), bool)
    if mode == "corner":
        out[np.ix_((0, height - 1), (0, width - 1))] = True
    elif mode == "border":
        out[[0, -1]] = out[:, [0, -1]] = True
    return out


def coarse_field(points: list[tuple[float, float, float, float]], height: int, width: int, boundary: str = "none", w_tps: float = 0.001, w_ui: float = 100.0) -> np.ndarray:
    """(height, width, 2): the field that bends least and goes through the control points; zero without any."""
    matrix = w_tps * thin_plate_matrix(height, width) / 2
    right = np.zeros((height * width, 2))
    for y, x, w, tx, ty in point_terms(points, height, width):
        at = y * width + x
        matrix[at, at] += w_ui * w / (height * width)
        right[at] += w_ui * w / (height * width) * np.array([tx, ty])
    held = np.flatnonzero(locked_mask(height, width, boundary))
    matrix[held, held] += LOCK
    try:
        found = np.linalg.solve(matrix, right)
        if not np.isfinite(found).all() or np.abs(matrix @ found - right).max() > 1e-6:
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        found = np.linalg.lstsq(matrix, right, rcond=None)[0]
    return found.reshape(height, width, 2)


def coarse_solve(pairs: DataFrame, points: list[tuple[float, float, float, float]], height: int, width: int, boundary: str = "none") -> DataFrame:
    """(pair_id, y, x, vx, vy) for each pair_id; pairs run in parallel."""
    def run(batches):
        field = coarse_field(points, height, width, boundary)
        y, x = np.mgrid[:height, :width]
        for batch in batches:
            for pair in batch["pair_id"]:
                yield pd.DataFrame({"pair_id": pair, "y": y.ravel(), "x": x.ravel(), "vx": field[..., 0].ravel(), "vy": field[..., 1].ravel()})

    return pairs.select("pair_id").distinct().mapInPandas(run, "pair_id long, y int, x int, vx double, vy double")


def jacobian_average(field: DataFrame, keys: tuple[str, ...] = KEYS, arranged: bool = False) -> DataFrame:
    """field with tax, tay, tbx, tby: columns of the mean Jacobian of both warps, by direction and by geometric length.

    Differences are backward, and forward in the first column and row. A column of length zero gives zeros.
    """
    wanted = {f"__{c}_{n}": (c, dy, dx) for c in ("vx", "vy") for n, dy, dx in (("l", 0, -1), ("r", 0, 1), ("u", -1, 0), ("d", 1, 0))}
    wide = neighbours(field, wanted, keys, arranged)

    def slope(c: str, low: str, high: str) -> Column:
        here = F.col(c)
        return F.coalesce(here - F.col(f"__{c}_{low}"), F.col(f"__{c}_{high}") - here, F.lit(0.0))

    out = {}
    for name, low, high, unit in (("a", "l", "r", (1.0, 0.0)), ("b", "u", "d", (0.0, 1.0))):
        sx, sy = slope("vx", low, high), slope("vy", low, high)
        cols = [(unit[0] + s * sx, unit[1] + s * sy) for s in (-1.0, 1.0)]
        sizes = [F.sqrt(cx * cx + cy * cy) for cx, cy in cols]
        safe = [F.nullif(s, F.lit(0.0)) for s in sizes]
        mx, my = (F.coalesce(cols[0][k] / safe[0], F.lit(0.0)) + F.coalesce(cols[1][k] / safe[1], F.lit(0.0)) for k in (0, 1))
        size = F.nullif(F.sqrt(mx * mx + my * my), F.lit(0.0))
        grow = F.sqrt(sizes[0] * sizes[1])
        out |= {f"t{name}x": F.coalesce(mx / size * grow, F.lit(0.0)), f"t{name}y": F.coalesce(my / size * grow, F.lit(0.0))}
    return wide.withColumns(out).drop(*wanted)


def _sides(height: int, width: int) -> list[tuple[Column, int]]:
    """The four neighbours of a pixel: whether there is one, and how much further its number is."""
    y, x = F.col("y"), F.col("x")
    return [(x > 0, -1), (x < width - 1, 1), (y > 0, -width), (y < height - 1, width)]


def path_grid(averaged: DataFrame, height: int, width: int, keys: tuple[str, ...] = KEYS, arranged: bool = True) -> DataFrame:
    """(keys, y, x, diagonal, bx, by): the path's system, pixel by pixel; what stands beside the diagonal is -1 for each
    neighbour.

    Between a pixel and its left or upper neighbour the path should differ by the target column less the identity;
    where the field is shorter than one, the pixel is also drawn to zero by what is missing.
    """
    y, x = F.col("y"), F.col("x")
    count = sum((F.when(there, 1.0).otherwise(0.0) for there, _ in _sides(height, width)), F.lit(0.0))
    pull = F.greatest(F.lit(0.0), 1.0 - F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    wanted = {"__ax": ("tax", 0, 1), "__ay": ("tay", 0, 1), "__bx": ("tbx", 1, 0), "__by": ("tby", 1, 0)}
    wide = neighbours(averaged, wanted, keys, arranged)

    def side(c: str, unit: tuple[float, float]) -> Column:
        low_x, low_y = F.when(x > 0, F.col(f"ta{c}") - unit[0]).otherwise(0.0), F.when(y > 0, F.col(f"tb{c}") - unit[1]).otherwise(0.0)
        return low_x + low_y - F.coalesce(F.col(f"__a{c}") - unit[0], F.lit(0.0)) - F.coalesce(F.col(f"__b{c}") - unit[1], F.lit(0.0))

    return wide.select(*keys, "y", "x", (count + pull).alias("diagonal"), side("x", (1.0, 0.0)).alias("bx"), side("y", (0.0, 1.0)).alias("by"))


def path_system(averaged: DataFrame, height: int, width: int, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(matrix, right side) of path_grid(): (keys, row, col, value) and (keys, row, bx, by); rows are y * width + x."""
    row = F.col("y") * width + F.col("x")
    grid = path_grid(averaged, height, width, keys)
    cells = [F.struct(row.alias("col"), F.col("diagonal").alias("value"))]
    cells += [F.when(there, F.struct((row + step).alias("col"), F.lit(-1.0).alias("value"))) for there, step in _sides(height, width)]
    matrix = grid.select(*keys, row.alias("row"), F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*keys, "row", "c.col", "c.value")
    return matrix, grid.select(*keys, row.alias("row"), "bx", "by")


def gradients(diagonal: np.ndarray, right: np.ndarray, free: np.ndarray | None = None, tol: float = 1e-3, start: np.ndarray | None = None, most: int = 5000) -> np.ndarray:
    """x (height, width) of the system with this diagonal and -1 for each pair of neighbouring free pixels, by conjugate
    gradients until the residual is tol of the right side; 0 where not free. Raises where `most` rounds do not do."""
    keep = np.ones(right.shape, bool) if free is None else free

    def product(p: np.ndarray) -> np.ndarray:
        out = diagonal * p
        out[1:] -= p[:-1]
        out[:-1] -= p[1:]
        out[:, 1:] -= p[:, :-1]
        out[:, :-1] -= p[:, 1:]
        return np.where(keep, out, 0.0)

    b = np.where(keep, right, 0.0)
    x = np.zeros(right.shape) if start is None else np.where(keep, start, 0.0)
    r = b - product(x)
    p, rr, stop = r.copy(), float((r * r).sum()), tol * tol * float((b * b).sum())
    for _ in range(most):
        if rr <= stop:
            return x
        ap = product(p)
        step = rr / float((p * ap).sum())
        x += step * p
        r -= step * ap
        rr, last = float((r * r).sum()), rr
        p = r + rr / last * p
    if rr > stop:
        raise ArithmeticError(f"no solution to {tol} of the right side in {most} rounds")
    return x


def quadratic_path(field: DataFrame, height: int, width: int, tol: float = 1e-3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, y, x, ux, uy): the path's bend for each pixel; both components are solved by conjugate gradients, pair by
    pair. A task gets the grid of a pair; `grid_solvers.path` is for those that are too large for one."""
    grid = path_grid(jacobian_average(field, keys), height, width, keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in field.select(*keys).schema) + ", y int, x int, ux double, uy double"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((3, height, width))
        held[:, part["y"], part["x"]] = part[["diagonal", "bx", "by"]].to_numpy(float).T
        ux, uy = (gradients(held[0], b, tol=tol) for b in held[1:])
        y, x = np.mgrid[:height, :width]
        return pd.DataFrame(dict(zip(keys, key)) | {"y": y.ravel(), "x": x.ravel(), "ux": ux.ravel(), "uy": uy.ravel()})

    return grid.groupBy(*keys).applyInPandas(run, schema)


def extended_canvas(df: DataFrame, height: int, width: int, share: float = 0.2, white: float = 255.0, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, x, v, a): the image on a canvas wider by `share` of its rows on every side; white and opaque outside."""
    edge = int(share * height)
    cells = F.explode(F.sequence(F.lit(0), F.lit((height + 2 * edge) * (width + 2 * edge) - 1)))
    blank = df.select(*keys).distinct().select(*keys, cells.alias("i")).select(*keys, F.expr(f"i div {width + 2 * edge}").cast("int").alias("y"), (F.col("i") % (width + 2 * edge)).cast("int").alias("x"))
    moved = df.select(*keys, (F.col("y") + edge).alias("y"), (F.col("x") + edge).alias("x"), "v")
    return blank.join(moved, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.coalesce("v", F.lit(white)).alias("v"), F.lit(255).alias("a"), F.col("v").isNotNull().alias("held"))


def filled_margin(canvas: DataFrame, tol: float = 1e-6, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The canvas with its margin filled smoothly from the image (a Laplace equation with open ends), image by image, to a
    residual of tol of the right side. A canvas without an image is white.

    This fill is our own: a margin that continues the image's border. `grid_solvers.margin` does the same by tiles.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in canvas.select(*keys).schema) + ", y int, x int, v double"

    def around(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, 1)
        return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        high, wide = int(part["y"].max()) + 1, int(part["x"].max()) + 1
        v, held = np.full((high, wide), 255.0), np.zeros((high, wide), bool)
        v[part["y"], part["x"]], held[part["y"], part["x"]] = part["v"], part["held"]
        if held.any():
            found = gradients(around(np.ones((high, wide))), around(np.where(held, v, 0.0)), ~held, tol, np.full((high, wide), v[held].mean()))
            v = np.where(held, v, found)
        y, x = np.mgrid[:high, :wide]
        return pd.DataFrame(dict(zip(keys, key)) | {"y": y.ravel(), "x": x.ravel(), "v": v.ravel()})

    return canvas.groupBy(*keys).applyInPandas(run, schema)
