"""Queries of filters with inverses, composed kernels, pyramids in linear light, layers, and solvers and matchers by tiles.

What is linear has SQL that multiplies by a matrix, which is made here by plain definitions: dense matrices and loops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.functions import composed, filters
from rastrel.functions.kernels import kernel
from rastrel.operators import grid_solvers, lines, matching, pyramids, render, solvers, tiled_matching
from rastrel.plans.base import EMB, EVT, FIELD, ORACLES, PAIRS, RGB, query, r, rounded, told
from rastrel.sources import rasters

KEYS, PAIR = ("image_id", "y", "x"), ("pair_id", "y", "x")


# matrices by definition


def _mirrored(i: int, n: int) -> int:
    while not 0 <= i < n:
        i = -1 - i if i < 0 else 2 * n - 1 - i
    return i


def _filter(taps: list[tuple[int, float]], n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for i in range(n):
        for k, w in taps:
            out[i, _mirrored(i + k, n)] += w
    return out


def _sampling(n: int, m: int, k: str) -> np.ndarray:
    """(m, n): the kernel at the distances of places from pixels; stretched, and its weights made one, where it shrinks."""
    out, ratio, pick = np.zeros((m, n)), n / m, kernel(k)
    for i in range(m):
        for j in range(-4 * n, 5 * n):
            out[i, _mirrored(j, n)] += pick.at([(j - ((i + 0.5) * ratio - 0.5)) / max(1.0, ratio)])[0]
    return out / out.sum(axis=1, keepdims=True) if ratio > 1 else out


def _cardinal(n: int, m: int, k: str = "bspline3") -> np.ndarray:
    """_sampling() with the inverse of the kernel's own samples: after it where it shrinks, else before."""
    taps = [(i, w) for i in range(-4, 5) if (w := float(kernel(k).at([float(i)])[0]))]
    return np.linalg.inv(_filter(taps, m)) @ _sampling(n, m, k) if m < n else _sampling(n, m, k) @ np.linalg.inv(_filter(taps, n))


def _swept(n: int, weights: tuple[float, ...], border: str, far: int = 400) -> np.ndarray:
    """Both sweeps of single ones on lines that are laid out far beyond their ends."""
    out = np.pad(np.eye(n), ((0, 0), (far, far)), mode={"edge": "edge", "reflect": "symmetric", "repeat": "wrap", "zero": "constant"}[border])
    b, *a = weights
    for _ in range(2):
        done = np.zeros((n, out.shape[1] + len(a)))
        if border == "edge":  # what a line that was there for ever has settled at
            done[:, : len(a)] = out[:, :1] * b / (1 - sum(a))
        for i in range(out.shape[1]):
            done[:, i + len(a)] = b * out[:, i] + sum(w * done[:, i + len(a) - 1 - k] for k, w in enumerate(a))
        out = done[:, len(a) :][:, ::-1]
        if border == "zero":
            keep = np.zeros(out.shape[1])
            keep[far : far + n] = 1
            out = out * keep
    return out[:, far : far + n].T


def _table(name: str, matrix: np.ndarray) -> str:
    rows = ", ".join(f"({i}, {j}, {matrix[i, j]!r}::DOUBLE)" for i, j in zip(*np.nonzero(np.abs(matrix) > 1e-15)))
    return f"{name} AS MATERIALIZED (SELECT * FROM (VALUES {rows.replace('np.float64(', '').replace(')::', '::')}) AS t(i, j, w))"


def _times(source: str, matrix: str, axis: str, value: str = "v", by: str = "image_id") -> str:
    other = "y" if axis == "x" else "x"
    return f"SELECT {by}, CAST(i AS INT) AS {axis}, {other}, sum(w * {value}) AS {value} FROM {source} JOIN {matrix} ON j = {axis} GROUP BY {by}, i, {other}"


def _both(ctes: str, source: str, rows: np.ndarray, columns: np.ndarray, digits: int = 6, by: str = "image_id") -> str:
    return f"""WITH {ctes}, {_table("down", rows)}, {_table("along", columns)}, wide AS ({_times(source, "along", "x", by=by)}), done AS ({_times("wide", "down", "y", by=by)})
  SELECT {by}, y, x, {r("v", "v", digits)} FROM done"""


# SQL of queries that had none

_PYRAMID = f"""WITH {EVT}, {_table("down", _cardinal(30, 15))}, {_table("along", _cardinal(24, 12))}, wide AS ({_times("evt", "along", "x")}), done AS ({_times("wide", "down", "y")})
  SELECT image_id, 0 AS level, y, x, {r("v", "v", 4)} FROM evt UNION ALL SELECT image_id, 1 AS level, y, x, {r("v", "v", 4)} FROM done"""
_POLES = filters.recursive_weights(2.0)
_BLUR = [_swept(n, _POLES[1], "edge") @ _swept(n, _POLES[0], "edge") for n in (30, 24)]


def _tapped(c: str, n: int, m: int) -> str:
    """The values of both taps on an axis and their weights."""
    place = f"(({c} + 0.5) * {n} / {m}.0::DOUBLE - 0.5)"
    return f"(least(greatest(floor({place}) + k, 0), {n - 1}))::INT AS n{c}, abs(1 - k - ({place} - floor({place}))) AS w{c}"


_LARGER = f"""WITH {PAIRS}, f AS (SELECT pair_id, y, x, {FIELD} FROM pairs), ty AS (SELECT CAST(y AS INT) AS y, {_tapped("y", 8, 16)} FROM range(16) AS a(y), range(2) AS b(k)), tx AS (SELECT CAST(x AS INT) AS x, {_tapped("x", 8, 12)} FROM range(12) AS a(x), range(2) AS b(k))
  SELECT pair_id, ty.y, tx.x, {r("sum(wy * wx * vx) * 12 / 8", "vx")}, {r("sum(wy * wx * vy) * 16 / 8", "vy")} FROM f JOIN ty ON ny = f.y JOIN tx ON nx = f.x GROUP BY ALL"""


def _thin_plate(n: int) -> np.ndarray:
    """Twice the sum of the squares of all second differences, of which the mixed ones count twice, as a matrix."""
    out, at = np.zeros((n * n, n * n)), lambda y, x: y * n + x
    for y in range(n):
        for x in range(n):
            for cells, weight in (
                ([(y, x, 1), (y, x + 1, -2), (y, x + 2, 1)], 2), ([(y, x, 1), (y + 1, x, -2), (y + 2, x, 1)], 2),
                ([(y, x, 1), (y, x + 1, -1), (y + 1, x, -1), (y + 1, x + 1, 1)], 4),
            ):
                if all(a < n and b < n for a, b, _ in cells):
                    for a, b, v in cells:
                        for c, d, w in cells:
                            out[at(a, b), at(c, d)] += weight * v * w
    return out


def _coarse() -> str:
    n, right, matrix = 8, np.zeros((64, 2)), 0.001 * _thin_plate(8) / 2
    for _, lx, ly, rx, ry in rasters.CONTROL_POINTS:
        cy, cx, way = (ly + ry) * n / 2 - 0.5, (lx + rx) * n / 2 - 0.5, ((rx - lx) * n / 2, (ry - ly) * n / 2)
        for y in range(n):
            for x in range(n):
                w = max(0.0, 1 - abs(y - cy)) * max(0.0, 1 - abs(x - cx))
                matrix[y * n + x, y * n + x] += 100 * w / n**2
                right[y * n + x] += 100 * w / n**2 * np.array(way)
    for y in range(n):
        for x in range(n):
            if {y, x} & {0, n - 1}:
                matrix[y * n + x, y * n + x] += 10
    found = np.linalg.solve(matrix, right)
    rows = ", ".join(f"({k // n}, {k % n}, {float(v[0])!r}::DOUBLE, {float(v[1])!r}::DOUBLE)" for k, v in enumerate(found))
    return f"WITH {PAIRS} SELECT pair_id, t.y, t.x, {r('vx', 'vx', 4)}, {r('vy', 'vy', 4)} FROM (SELECT DISTINCT pair_id FROM pairs), (VALUES {rows}) AS t(y, x, vx, vy)"


ORACLES |= {
    "vector_upsample": _LARGER,
    "pyramid_cpu": _PYRAMID,
    "pyramid_gpu": _PYRAMID,
    "gaussian_blur": _both(EVT, "evt", *_BLUR, digits=4),
    "coarse_solve": _coarse(),
}


# filters and composed kernels


_LEANING = [(-1, 0.2), (0, 1.0), (1, -0.35), (2, 0.1)]


@query(_both(EVT, "evt", np.linalg.inv(_filter(_LEANING, 30)), np.linalg.inv(_filter(_LEANING, 24))))
def ifir_asymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse of a filter that leans to one side."""
    return told(lines.ifir(rasters.event_grid(spark, sf_dir), _LEANING), KEYS, v="v")


@query(_both(EVT, "evt", np.linalg.inv(_filter(filters.taps("ifir_condat2"), 30)), np.linalg.inv(_filter(filters.taps("ifir_condat2"), 24))))
def ifir_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter of the catalogue that is there to be solved for."""
    return told(lines.ifir(rasters.event_grid(spark, sf_dir), filters.taps("ifir_condat2")), KEYS, v="v")


@query(_both(EVT, "evt", _cardinal(30, 45), _cardinal(24, 36)))
def interpolated_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger by a cubic B-spline that goes through the values: filtered first, then reconstructed."""
    return told(lines.reconstructed(rasters.event_grid(spark, sf_dir), 30, 24, 45, 36, composed.interpolating("bspline3")), KEYS, v="v")


@query(_both(EVT, "evt", _filter(filters.taps("fir_dalai1"), 13) @ _sampling(30, 13, "omoms3"), _sampling(24, 31, "omoms3") @ _filter(filters.taps("fir_dalai1"), 24)))
def composed_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One axis smaller and one larger by a kernel that comes with a filter."""
    k = composed.generalized(filters.taps("fir_dalai1"), [(0, 1.0)], "omoms3")
    return told(lines.reconstructed(rasters.event_grid(spark, sf_dir), 30, 24, 13, 31, k), KEYS, v="v")


_CURVE = "CASE WHEN {0} <= 0.0031308 THEN 12.92 * {0} ELSE 1.055 * pow(greatest({0}, 0), 1 / 2.4) - 0.055 END"
_UNCURVE = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"


def _over(source: str, curve: str) -> str:
    return f"(SELECT image_id, y, x, {curve.format('v')} AS v FROM {source})"


@query(f"""WITH {RGB}, light AS (SELECT image_id, y, x, {_UNCURVE.format("g")} AS v FROM rgb), {_table("m", _cardinal(8, 12))},
  wide AS ({_times(_over("light", _CURVE), "m", "x")}), back AS {_over("wide", _UNCURVE)}, done AS ({_times(_over("back", _CURVE), "m", "y")}) SELECT image_id, y, x, {r(_UNCURVE.format("v"), "v")} FROM done""")
def upsample_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear light made larger in the space of the sRGB curve, by a kernel that goes through the values."""
    light = rasters.embedding_rgb(spark, sf_dir).select(*KEYS, pyramids.loaded(255 * F.col("g")).alias("v"))
    return told(lines.reconstructed(light, 8, 8, 12, 12, composed.interpolating("bspline3"), gamma=True), KEYS, v="v")


_ORDER_TWO = (0.25, 1.1, -0.35)


@query(f"WITH {EVT}, {_table('m', _swept(24, _ORDER_TWO, 'edge'))}, done AS ({_times('evt', 'm', 'x')}) SELECT image_id, y, x, {r('v', 'v', 4)} FROM done")
def blocked_scan_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursion of order two along lines that are cut into blocks of five."""
    return told(lines.swept_by_blocks(rasters.event_grid(spark, sf_dir), "x", _ORDER_TWO, "edge", 5), KEYS, 4, v="v")


@query(f"WITH {EVT}, {_table('m', _swept(30, _ORDER_TWO, 'reflect'))}, done AS ({_times('evt', 'm', 'y')}) SELECT image_id, y, x, {r('v', 'v', 4)} FROM done")
def blocked_scan_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(lines.swept_by_blocks(rasters.event_grid(spark, sf_dir), "y", _ORDER_TWO, "reflect", 7), KEYS, 4, v="v")


# pyramids in linear light


def _rgb_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in whole bytes, with masks by place."""
    df = rasters.embedding_rgb(spark, sf_dir).withColumns({c: F.floor(255 * F.col(c)) for c in "rgb"})
    return rasters.synthetic_masks(df)


_BYTES = f"""{RGB}, bytes AS (SELECT image_id, y, x, {", ".join(f"floor(255 * {c}) AS {c}" for c in "rgb")}, (x + y) % 5 <> 0 AND x < 2 AS white FROM rgb)"""


@query(f"""WITH {_BYTES}, {_table("m", _cardinal(8, 4))}, {", ".join(f"{c}0 AS (SELECT image_id, y, x, CASE WHEN white THEN 1 ELSE {_UNCURVE.format(f'({c} / 255)')} END AS v FROM bytes), {c}1 AS ({_times(f'{c}0', 'm', 'x')}), {c}2 AS ({_times(f'{c}1', 'm', 'y')})" for c in "rgb")}
  SELECT image_id, 1 AS level, y, x, {", ".join(r(f"{c}2.v", c) for c in "rgb")} FROM r2 JOIN g2 USING (image_id, y, x) JOIN b2 USING (image_id, y, x)""")
def linear_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels after the first in linear light; pixels outside of the layer are white."""
    return told(pyramids.light_levels(_rgb_bytes(spark, sf_dir), 8, 8, 4), ("image_id", "level", "y", "x"), r="r", g="g", b="b")


@query(None)
def byte_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels in bytes, with their gray."""
    return pyramids.byte_levels(_rgb_bytes(spark, sf_dir), 8, 8, 4)


# layers


def _layered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Merged images of two layers of each pair of colour images: (image_id, layer, y, x, b, g, r, a)."""
    df = rasters.embedding_rgb(spark, sf_dir).withColumns({c: 255 * F.col(c) for c in "rgb"})
    masks = df.select(*KEYS, F.explode(F.array(F.lit(0), F.lit(1))).alias("layer")).withColumn("g", F.when(F.col("layer") == 0, F.when(F.col("x") < 3, 255.0).otherwise(0.0)).otherwise(F.when(F.col("y") > 4, 51.0).otherwise(255.0)))
    both = df.withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
    made = render.merged(both, masks, ("image_id", "layer")).withColumns({"side": F.col("image_id") % 2, "pair_id": F.expr("image_id div 2")}).drop("image_id")
    own = [made.where(F.col("side") == k).drop("side") for k in (0, 1)]
    return own[0], own[1]


_MASK = "CASE WHEN layer = 0 THEN CASE WHEN x < 3 THEN 255.0 ELSE 0 END ELSE CASE WHEN y > 4 THEN 51.0 ELSE 255 END END"
_MERGED = f"""{RGB}, merged AS MATERIALIZED (SELECT image_id // 2 AS pair_id, image_id % 2 AS side, CAST(layer AS INT) AS layer, y, x, 255 * b AS b, 255 * g AS g, 255 * r AS r, {_MASK}::DOUBLE AS a FROM rgb, range(2) AS t(layer))"""


@query(f"WITH {_MERGED} SELECT pair_id, layer, y, x, {', '.join(r(c, c) for c in 'bgra')} FROM merged WHERE side = 1")
def channel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours with the mask's green as their fourth channel."""
    return told(_layered(spark, sf_dir)[1], ("pair_id", "layer", "y", "x"), b="b", g="g", r="r", a="a")


def _canvas_taps(side: int, sign: str) -> str:
    """Bilinear taps of a canvas one pixel wider on every side."""
    at = lambda c: f"({c} {sign} v{c} + 1)"
    weight = " * ".join(f"(1 - abs({at(c)} - (floor({at(c)}) + {k})))" for c, k in (("y", "i"), ("x", "j")))
    return f"""SELECT f.pair_id, f.layer, f.y, f.x, {", ".join(f"sum(wt * coalesce(m.{c}, 255)) AS {c}" for c in "bgra")} FROM (SELECT *, least(greatest(floor({at('y')}) + i, 0), 9) - 1 AS py, least(greatest(floor({at('x')}) + j, 0), 9) - 1 AS px, {weight} AS wt
      FROM field, range(2) AS s(i), range(2) AS u(j)) f LEFT JOIN merged m ON m.side = {side} AND m.pair_id = f.pair_id AND m.layer = f.layer AND m.y = py AND m.x = px GROUP BY ALL"""


@query(f"""WITH {_MERGED}, held AS (SELECT pair_id FROM merged GROUP BY 1 HAVING count(DISTINCT side) = 2), field AS (SELECT pair_id, layer, y, x, vx / (layer + 1) AS vx, vy / (layer + 1) AS vy FROM (SELECT pair_id, layer, y, x, {FIELD} FROM merged WHERE side = 0 AND pair_id IN (SELECT pair_id FROM held))),
  one AS ({_canvas_taps(0, "-")}), two AS ({_canvas_taps(1, "+")}), means AS (SELECT o.pair_id, o.layer, o.y, o.x, {", ".join(f"(o.{c} + t.{c}) / 2 AS {c}" for c in "bgra")} FROM one o JOIN two t USING (pair_id, layer, y, x)),
  flat AS (SELECT pair_id, y, x, {", ".join(f"max({c}) FILTER (layer = {z}) AS {c}{z}" for z in (0, 1) for c in "bgra")} FROM means GROUP BY ALL)
  SELECT pair_id, y, x, {", ".join(r(f"(255 * (a1 / 255) + {c}1 * (1 - a1 / 255)) * (a0 / 255) + {c}0 * (1 - a0 / 255)", c, 4) for c in "bgr")} FROM flat""")
def layer_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halfway images of two layers on extended canvases, each with a field of its own, the second below the first."""
    keys = ("pair_id", "layer")
    first, second = (render.canvas(m, 8, 8, 1, keys) for m in _layered(spark, sf_dir))
    base = first.select("pair_id", "layer").distinct().join(second.select("pair_id", "layer").distinct(), list(keys))
    cells = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63)))).select(*keys, F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"))
    field = rasters.synthetic_field(cells).withColumns({c: F.col(c) / (F.col("layer") + 1) for c in ("vx", "vy")})
    made = render.halfway_layers(field, first, second, 8, 8, 1, keys)
    return told(render.blended(made.withColumn("z_order", 1 - F.col("layer")), ("pair_id",)), PAIR, 4, b="b", g="g", r="r")


# solvers and matchers


@query(f"""WITH {PAIRS}, f AS (SELECT pair_id, y, x, {FIELD} FROM pairs), o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS t(dy, dx))
  SELECT pair_id, y * 8 + x AS row, (y + dy) * 8 + x + dx AS col, {r("CASE WHEN dy = 0 AND dx = 0 THEN greatest(0, 1 - sqrt(vx * vx + vy * vy)) + (x > 0)::INT + (x < 7)::INT + (y > 0)::INT + (y < 7)::INT ELSE -1 END", "value", 4)}
  FROM f, o WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7""")
def path_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matrix of the path's system."""
    field = rasters.synthetic_field(rasters.embedding_pairs(spark, sf_dir))
    matrix, _ = solvers.path_system(solvers.jacobian_average(field, arranged=True), 8, 8)
    return matrix.select("pair_id", "row", "col", rounded("value", 4).alias("value"))


def _margin(digits: int = 2) -> str:
    """What each pixel of a canvas is of the image's pixels: Laplace's equation with open ends, solved by elimination."""
    n, held = 10, lambda y, x: 0 < y < 9 and 0 < x < 9
    free = [(y, x) for y in range(n) for x in range(n) if not held(y, x)]
    inner = [(y, x) for y in range(n) for x in range(n) if held(y, x)]
    matrix, right = np.zeros((len(free), len(free))), np.zeros((len(free), len(inner)))
    for k, (y, x) in enumerate(free):
        for at in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= at[0] < n and 0 <= at[1] < n:
                matrix[k, k] += 1
                if held(*at):
                    right[k, inner.index(at)] += 1
                else:
                    matrix[k, free.index(at)] -= 1
    out = np.linalg.solve(matrix, right)
    rows = [(*at, y - 1, x - 1, out[k, i]) for k, at in enumerate(free) for i, (y, x) in enumerate(inner) if abs(out[k, i]) > 1e-15] + [(y, x, y - 1, x - 1, 1.0) for y, x in inner]
    table = ", ".join(f"({', '.join(map(str, row[:4]))}, {float(row[4])!r}::DOUBLE)" for row in rows)
    return f"WITH {EMB} SELECT image_id, t.y, t.x, {r('sum(w * v)', 'v', digits)} FROM emb JOIN (VALUES {table}) AS t(y, x, iy, ix, w) ON iy = emb.y AND ix = emb.x GROUP BY ALL"


ORACLES["filled_margin"] = _margin(4)


@query(_margin())
def filled_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A margin solved by nested grids, to rounding; canvases under 1,024 pixels side by side, larger ones by rounds."""
    canvas = solvers.extended_canvas(rasters.embedding_images(spark, sf_dir), 8, 8)
    return told(grid_solvers.margin(canvas, 10, 10, 1e-12, whole=1024).values, KEYS, 2, v="v")


def _event_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of 30 by 24 for each type of event, that points along the density's slope."""
    grid = rasters.event_grid(spark, sf_dir).withColumnRenamed("image_id", "pair_id")
    top = grid.groupBy("pair_id").agg(F.max("v").alias("top"))
    lean = F.col("v") / F.nullif(F.col("top"), F.lit(0.0))
    return grid.join(top, "pair_id").select(*PAIR, F.coalesce(lean, F.lit(0.0)).alias("vx"), F.coalesce(0.5 - lean / 2, F.lit(0.0)).alias("vy"))


@query(None)
def multilevel_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path's bend for images of several tiles, from small ones to whole ones."""
    return told(grid_solvers.multilevel_path(_event_field(spark, sf_dir), 30, 24, 1e-4).values, PAIR, 4, ux="ux", uy="uy")


def _layer_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers for each pair of embeddings: as they are; and stiffer, with a point from the vectors' labels and masks
    from the pixels."""
    pairs = rasters.embedding_pairs(spark, sf_dir)
    labels = rasters.table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 2").alias("pair_id")).agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n")).where("n = 2")
    layer = F.explode(F.array(F.lit(0), F.lit(1))).alias("layer")
    of = lambda first, second: F.when(F.col("layer") == 0, F.lit(first)).otherwise(F.lit(second))
    parameters = labels.select("pair_id", layer).select("pair_id", "layer", of(0.001, 0.01).alias("w_tps"), of("none", "corner").alias("boundary"), F.lit(4).alias("start_res"), F.lit(64).alias("max_iter"))
    place = 0.25 + (F.col("label") % 4) / 8
    points = labels.select("pair_id", F.lit(1).alias("layer"), F.lit(0).alias("idx"), place.alias("lx"), F.lit(0.5).alias("ly"), (place + 0.0625).alias("rx"), F.lit(0.5).alias("ry"))
    masks = pairs.select("pair_id", F.lit(1).alias("layer"), "y", "x", *(F.when(F.col(f"v{k}") > 200, 255.0).otherwise(0.0).alias(f"mask{k}") for k in (0, 1)))
    return matching.jobs(pairs, parameters, points, masks)


@query(None)
def morph_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halfway fields of two layers of each pair, each with its own weights, points and masks."""
    return told(matching.fields(matching.matched(_layer_jobs(spark, sf_dir))), ("pair_id", "layer", "y", "x"), 4, vx="vx", vy="vy")


@query(None)
def match_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps by level of the same jobs (their times are not told here, as they are never the same)."""
    return matching.schedule(matching.matched(_layer_jobs(spark, sf_dir))).drop("ms")


@query(None)
def tiled_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halfway fields between densities of events, of each type and the next one, improved by windows of 12 pixels."""
    grid = rasters.event_grid(spark, sf_dir)
    top = grid.groupBy("image_id").agg(F.max("v").alias("top"))
    shade = grid.join(top, "image_id").select(*KEYS, (255 * F.col("v") / F.greatest(F.col("top"), F.lit(1.0))).alias("v"))
    types = grid.select("image_id").distinct()
    following = types.alias("a").join(types.alias("b"), F.col("a.image_id") < F.col("b.image_id")).groupBy(F.col("a.image_id").alias("image_id")).agg(F.min("b.image_id").alias("other"))  # an image a type of event
    first = shade.join(following, "image_id").select(F.xxhash64("image_id").alias("pair_id"), "other", "y", "x", F.col("v").alias("v0"))
    pairs = first.join(shade.select(F.col("image_id").alias("other"), "y", "x", F.col("v").alias("v1")), ["other", "y", "x"]).drop("other")
    field = first.select("pair_id", "y", "x", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    made = tiled_matching.improved(field, pairs, (30, 24), matching.Settings(w_tps=0.01), 1, 12, 16)
    return told(made, PAIR, 4, vx="vx", vy="vy")
