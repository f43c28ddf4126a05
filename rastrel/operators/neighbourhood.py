"""Framed computations over dense rasters: windows along rows, then along columns, after one exchange by tiles of images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("image_id",)


def _row(keys: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*keys, "y").orderBy("x")


def _column(keys: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*keys, "x").orderBy("y")


#: Rows of a tile. An image of more rows is worked on by a task for each tile, with the rows around it that it needs.
TILE = 256


def _tiled(df: DataFrame, keys: tuple[str, ...], reach: int, arranged: bool) -> tuple[DataFrame, tuple[str, ...]]:
    """df with its tile `__t`, rows within `reach` of other tiles also in those, after one exchange that serves the windows
    of both axes; and the keys of these. None is needed where the images' pixels are together already."""
    if arranged:
        return df, keys
    low, high = (F.floor((F.col("y") + F.lit(k)) / F.lit(TILE)) for k in (-reach, reach))
    return df.withColumn("__t", F.explode(F.sequence(low, high))).repartition(*keys, "__t"), (*keys, "__t")


def _own(df: DataFrame, arranged: bool) -> DataFrame:
    """The rows of tiles without those around them."""
    return df if arranged else df.where(F.col("__t") == F.floor(F.col("y") / F.lit(TILE))).drop("__t")


def box(df: DataFrame, sums: dict[str, Column], radius: int = 2, keys: tuple[str, ...] = KEYS, how=F.sum, arranged: bool = False) -> DataFrame:
    """df with each expression summed (or otherwise combined) over the square of the radius, clipped at the border."""
    wide, by = _tiled(df, keys, radius, arranged)
    row, column = _row(by).rangeBetween(-radius, radius), _column(by).rangeBetween(-radius, radius)
    wide = wide.withColumns({f"__{n}": e for n, e in sums.items()})
    wide = wide.withColumns({f"__{n}": how(f"__{n}").over(row) for n in sums})
    return _own(wide.withColumns({n: how(f"__{n}").over(column) for n in sums}).drop(*(f"__{n}" for n in sums)), arranged)


def moments(df: DataFrame, radius: int = 2, keys: tuple[str, ...] = ("pair_id",), l0: str = "l0", l1: str = "l1", weight: str | None = None, arranged: bool = False) -> DataFrame:
    """n, s0, s1, q0, q1 and c: weighted sums over the square of 1, both images, their squares and their product."""
    a, b, m = F.col(l0), F.col(l1), F.col(weight) if weight else F.lit(1.0)
    return box(df, {"n": m, "s0": m * a, "s1": m * b, "q0": m * a * a, "q1": m * b * b, "c": m * a * b}, radius, keys, arranged=arranged)


def neighbour_count(df: DataFrame, radius: int = 2, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return box(df, {"n": F.lit(1)}, radius, keys)


def any_flag(df: DataFrame, flag: str, name: str, radius: int = 2, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Whether the flag is set anywhere in the square."""
    return box(df, {name: F.col(flag).cast("boolean")}, radius, keys, F.max)


def neighbours(df: DataFrame, wanted: dict[str, tuple[str, int, int]], keys: tuple[str, ...] = KEYS, arranged: bool = False) -> DataFrame:
    """df with columns name: the value of (column, dy, dx) at the pixel dy below and dx to the right; null outside."""
    along = {f"__{c}_{dx}".replace("-", "m"): (c, dx) for c, _, dx in wanted.values()}
    wide, by = _tiled(df, keys, max(abs(dy) for _, dy, _ in wanted.values()), arranged)
    wide = wide.withColumns({n: F.lead(c, dx).over(_row(by)) if dx else F.col(c) for n, (c, dx) in along.items()})
    found = {}
    for name, (c, dy, dx) in wanted.items():
        source = f"__{c}_{dx}".replace("-", "m")
        found[name] = F.lead(source, dy).over(_column(by)) if dy else F.col(source)
    return _own(wide.withColumns(found).drop(*along), arranged)


def gather(df: DataFrame, value: str = "v", radius: int = 2, keys: tuple[str, ...] = KEYS, fill: float = 0.0) -> DataFrame:
    """df with nb: the square's values as an array, row by row; cells outside hold fill."""
    span = range(-radius, radius + 1)
    wide, by = _tiled(df, keys, radius, False)
    wide = wide.withColumn("__row", F.array(*(F.lead(value, dx).over(_row(by)) for dx in span)))
    blank = F.array(*(F.lit(fill) for _ in span))
    filled = wide.withColumn("__row", F.transform("__row", lambda e: F.coalesce(e, F.lit(fill))))
    rows = [F.coalesce(F.lead("__row", dy).over(_column(by)), blank) for dy in span]
    return _own(filled.withColumn("nb", F.flatten(F.array(*rows))).drop("__row"), False)


#: The eight neighbours, clockwise from the upper left, as (dy, dx).
RING = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def one_ring(df: DataFrame, sign: int, keys: tuple[str, ...] = ("pair_id",), arranged: bool = False) -> DataFrame:
    """df with ring: displaced places (px, py) of the eight neighbours, q' + sign v(q'); a missing one moves as q does."""
    wanted = {f"__{c}{k}": (c, dy, dx) for k, (dy, dx) in enumerate(RING) for c in ("vx", "vy")}
    wide = neighbours(df, wanted, keys, arranged)
    places = [
        F.struct(
            (F.col("x") + dx + sign * F.coalesce(f"__vx{k}", F.col("vx"))).alias("px"), (F.col("y") + dy + sign * F.coalesce(f"__vy{k}", F.col("vy"))).alias("py")
        )
        for k, (dy, dx) in enumerate(RING)
    ]
    return wide.withColumn("ring", F.array(*places)).drop(*wanted)


def border_class(i: Column, n: Column | int) -> Column:
    """0 and 1 next to the low side, 3 and 4 next to the high one, 2 inside."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(i == 0, 0).when(i == 1, 1).when(i == n - 1, 4).when(i == n - 2, 3).otherwise(2)


def locked(y: Column, x: Column, height: int, width: int, mode: str = "none") -> Column:
    """Pixels that may not move: none, the four corners, or the whole border."""
    at_x, at_y = (x == 0) | (x == width - 1), (y == 0) | (y == height - 1)
    if mode not in ("none", "corner", "border"):
        raise ValueError(f"no boundary {mode}")
    return F.lit(False) if mode == "none" else at_x & at_y if mode == "corner" else at_x | at_y


def thin_plate_matrix(height: int, width: int) -> np.ndarray:
    """The Hessian of the thin-plate energy: twice dxx'dxx + dyy'dyy + 2 dxy'dxy, over differences inside the image."""
    def differences(n: int, taps: tuple[float, ...]) -> np.ndarray:
        rows = np.zeros((max(0, n - len(taps) + 1), n))
        for k, t in enumerate(taps):
            rows[np.arange(len(rows)), np.arange(len(rows)) + k] = t
        return rows

    dxx = np.kron(np.eye(height), differences(width, (1, -2, 1)))
    dyy = np.kron(differences(height, (1, -2, 1)), np.eye(width))
    dxy = np.kron(differences(height, (-1, 1)), differences(width, (-1, 1)))
    return 2 * (dxx.T @ dxx + dyy.T @ dyy + 2 * dxy.T @ dxy)


def thin_plate_stencils() -> np.ndarray:
    """stencils[by, bx] is the 5 by 5 gradient stencil of a pixel of that border class; entries of each sum to zero."""
    full, at = thin_plate_matrix(9, 9).reshape(9, 9, 9, 9), (0, 1, 4, 7, 8)
    out = np.zeros((5, 5, 5, 5))
    for by, y in enumerate(at):
        for bx, x in enumerate(at):
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    if 0 <= y + dy < 9 and 0 <= x + dx < 9:
                        out[by, bx, dy + 2, dx + 2] = full[y, x, y + dy, x + dx]
    return out


def io_mask() -> np.ndarray:
    """mask[by, bx, dy, dx]: whether the cell (dy - 2, dx - 2) is inside the image for a pixel of that border class."""
    inside = np.array([[0 <= c + d < 5 for d in range(-2, 3)] for c in range(5)])
    return inside[:, None, :, None] & inside[None, :, None, :]


def with_io_mask(df: DataFrame, height: int, width: int) -> DataFrame:
    """df with `inside`: io_mask() of each pixel's border class, row by row, as an array of 25."""
    rows = [(by, bx, [bool(v) for v in cell.ravel()]) for by, line in enumerate(io_mask()) for bx, cell in enumerate(line)]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "__by int, __bx int, inside array<boolean>"))  # 25 rows
    classes = df.withColumns({"__by": border_class(F.col("y"), height), "__bx": border_class(F.col("x"), width)})
    return classes.join(table, ["__by", "__bx"]).drop("__by", "__bx")


def _stencil_table(df: DataFrame) -> DataFrame:
    rows = [(by, bx, s.ravel().tolist()) for by, line in enumerate(thin_plate_stencils()) for bx, s in enumerate(line)]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "__by int, __bx int, __w array<double>"))  # 25 rows


def thin_plate_gradient(df: DataFrame, height: int, width: int, value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df with tps: the gradient of the thin-plate energy. Both sides are 5 pixels at least."""
    wide = gather(df, value, 2, keys).withColumns({"__by": border_class(F.col("y"), height), "__bx": border_class(F.col("x"), width)})
    dot = F.aggregate(F.zip_with("nb", "__w", lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    return wide.join(_stencil_table(df), ["__by", "__bx"]).withColumn("tps", dot).drop("__by", "__bx", "__w", "nb")


def thin_plate_scatter(df: DataFrame, height: int, width: int, step: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, y, x, b): what steps of all pixels add to the gradient of each; sums by target, with partial sums."""
    classes = df.withColumns({"__by": border_class(F.col("y"), height), "__bx": border_class(F.col("x"), width)})
    out = classes.join(_stencil_table(df), ["__by", "__bx"]).select(*keys, "y", "x", F.col(step).alias("d"), F.posexplode("__w").alias("i", "w")).where("w <> 0")
    target = out.select(*keys, (F.col("y") + F.expr("i div 5") - 2).cast("int").alias("y"), (F.col("x") + F.col("i") % 5 - 2).cast("int").alias("x"), (F.col("w") * F.col("d")).alias("b"))
    return target.groupBy(*keys, "y", "x").agg(F.sum("b").alias("b"))


def derivatives(df: DataFrame, value: str = "v", keys: tuple[str, ...] = KEYS, arranged: bool = False) -> DataFrame:
    """df with central differences dx, dy, dxx, dxy and dyy; a neighbour outside is the pixel itself or its own row's or column's."""
    wanted = {f"__{dy}{dx}".replace("-", "m"): (value, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx}
    wide = neighbours(df, wanted, keys, arranged)
    here = F.col(value)

    def raw(dy: int, dx: int) -> Column:
        return F.col(f"__{dy}{dx}".replace("-", "m")) if dy or dx else here

    def at(dy: int, dx: int) -> Column:
        return F.coalesce(raw(dy, dx), raw(0, dx), raw(dy, 0), here)

    return wide.withColumns({
        "dx": (at(0, 1) - at(0, -1)) / 2.0, "dy": (at(1, 0) - at(-1, 0)) / 2.0,
        "dxx": at(0, 1) - 2.0 * here + at(0, -1), "dyy": at(1, 0) - 2.0 * here + at(-1, 0),
        "dxy": (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / 4.0,
    }).drop(*wanted)
