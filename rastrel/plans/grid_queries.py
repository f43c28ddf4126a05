"""Queries of neighbourhoods, energies, samplers, filters, solvers, contours and frames."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastrel.functions import filters
from rastrel.functions.kernels import KERNELS, kernel
from rastrel.operators import energy, graph, lines, matching, neighbourhood, render, resample, solvers
from rastrel.plans.base import EMB, EVT, FIELD, PAIRS, boxes, query, r, rounded, told
from rastrel.sources import rasters

KEYS, PAIR = ("image_id", "y", "x"), ("pair_id", "y", "x")
SUMS = {"n": "1", "s0": "b.v0", "s1": "b.v1", "q0": "b.v0 * b.v0", "q1": "b.v1 * b.v1", "c": "b.v0 * b.v1"}


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.embedding_pairs(spark, sf_dir)


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.synthetic_field(_pairs(spark, sf_dir))


# neighbourhoods


@query(f"WITH {EMB} SELECT image_id, y, x, CAST(n AS INT) AS n, {r('s / n', 'mean')}, {r('q / n - (s / n) * (s / n)', 'var', 4)} FROM ({boxes('emb', 'image_id', {'n': '1', 's': 'b.v', 'q': 'b.v * b.v'})})")
def box_moments_5x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    df = neighbourhood.box(rasters.embedding_images(spark, sf_dir), {"n": F.lit(1), "s": v, "q": v * v}, arranged=True)
    mean = F.col("s") / F.col("n")
    return df.select(*KEYS, F.col("n").cast("int").alias("n"), rounded(mean).alias("mean"), rounded(F.col("q") / F.col("n") - mean * mean, 4).alias("var"))


@query(f"WITH {EVT} SELECT image_id, y, x, (least(y, 2) + least(29 - y, 2) + 1) * (least(x, 2) + least(23 - x, 2) + 1) AS n FROM evt")
def neighbour_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.neighbour_count(rasters.event_grid(spark, sf_dir)).select(*KEYS, F.col("n").cast("int").alias("n"))


@query(f"WITH {EVT} SELECT a.image_id, a.y, a.x, bool_or(b.v > 30) AS improving FROM evt a JOIN evt b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL")
def any_improving(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rasters.event_grid(spark, sf_dir).withColumn("flag", F.col("v") > 30)
    return neighbourhood.any_flag(df, "flag", "improving").select(*KEYS, "improving")


@query(f"""WITH {EVT}, o AS (SELECT CAST(i // 5 - 2 AS INT) AS dy, CAST(i % 5 - 2 AS INT) AS dx, i FROM range(25) AS t(i))
  SELECT a.image_id, a.y, a.x, {r("sum((i + 1) * coalesce(b.v, 0))", "checked")}, CAST(count(b.v) AS INT) AS inside FROM evt a CROSS JOIN o
  LEFT JOIN evt b ON a.image_id = b.image_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL""")
def gather_5x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 neighbours in order, told by a sum with a weight for each place."""
    df = neighbourhood.gather(rasters.event_grid(spark, sf_dir).withColumn("v", F.col("v")), fill=-1.0)
    zero = F.lit(0.0)
    checked = F.aggregate(F.transform("nb", lambda e, i: (i + 1) * F.when(e < 0, 0.0).otherwise(e)), zero, lambda s, e: s + e)
    return df.select(*KEYS, rounded(checked).alias("checked"), F.size(F.filter("nb", lambda e: e >= 0)).alias("inside"))


@query(f"""WITH {PAIRS}, f AS (SELECT pair_id, y, x, {FIELD} FROM pairs), o AS (SELECT * FROM (VALUES {", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(neighbourhood.RING))}) AS t(k, dy, dx))
  SELECT a.pair_id, a.y, a.x, {r("sum((k + 1) * (a.x + dx + coalesce(b.vx, a.vx)))", "sx")}, {r("sum((k + 1) * (a.y + dy + coalesce(b.vy, a.vy)))", "sy")}
  FROM f a CROSS JOIN o LEFT JOIN f b ON a.pair_id = b.pair_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL""")
def one_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = neighbourhood.one_ring(_field(spark, sf_dir), 1, arranged=True)
    total = lambda c: F.aggregate(F.transform("ring", lambda e, i: (i + 1) * e[c]), F.lit(0.0), lambda s, e: s + e)
    return df.select(*PAIR, rounded(total("px")).alias("sx"), rounded(total("py")).alias("sy"))


_DIFF = """dxx AS (SELECT a.image_id, a.y, a.x, l.v - 2 * a.v + r.v AS d FROM evt a JOIN evt l ON l.image_id = a.image_id AND l.y = a.y AND l.x = a.x - 1 JOIN evt r ON r.image_id = a.image_id AND r.y = a.y AND r.x = a.x + 1),
  dyy AS (SELECT a.image_id, a.y, a.x, l.v - 2 * a.v + r.v AS d FROM evt a JOIN evt l ON l.image_id = a.image_id AND l.x = a.x AND l.y = a.y - 1 JOIN evt r ON r.image_id = a.image_id AND r.x = a.x AND r.y = a.y + 1),
  dxy AS (SELECT a.image_id, a.y, a.x, a.v - b.v - c.v + e.v AS d FROM evt a JOIN evt b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 1 JOIN evt c ON c.image_id = a.image_id AND c.y = a.y + 1 AND c.x = a.x JOIN evt e ON e.image_id = a.image_id AND e.y = a.y + 1 AND e.x = a.x + 1),
  parts AS (SELECT image_id, y, x + o AS x, CASE o WHEN 0 THEN -2 ELSE 1 END * 2 * d AS g FROM dxx, range(-1, 2) AS t(o) UNION ALL SELECT image_id, y + o, x, CASE o WHEN 0 THEN -2 ELSE 1 END * 2 * d FROM dyy, range(-1, 2) AS t(o)
    UNION ALL SELECT image_id, y + i, x + j, CASE WHEN i = j THEN 4 ELSE -4 END * d FROM dxy, range(2) AS s(i), range(2) AS t(j))"""


@query(f"WITH {EVT}, {_DIFF} SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {r('sum(g)', 'tps')} FROM parts GROUP BY ALL")
def tps_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By stencils of the border class; the SQL goes by the differences that the energy is made of."""
    return told(neighbourhood.thin_plate_gradient(rasters.event_grid(spark, sf_dir), 30, 24), KEYS, tps="tps")


@query(f"WITH {EVT}, {_DIFF} SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {r('sum(g)', 'b')} FROM parts GROUP BY ALL")
def tps_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What steps of all pixels add to each gradient: the stencils are symmetric, so it equals the gradient of the steps."""
    return told(neighbourhood.thin_plate_scatter(rasters.event_grid(spark, sf_dir), 30, 24), KEYS, b="b")


@query(f"""WITH {EVT} SELECT image_id, y, x, CAST(count(*) AS INT) AS cells, CAST(sum(i) AS INT) AS places FROM evt, range(25) AS t(i)
  WHERE y + i // 5 - 2 BETWEEN 0 AND 29 AND x + i % 5 - 2 BETWEEN 0 AND 23 GROUP BY ALL""")
def io_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pixel, how many cells of its square are inside, and the sum of their numbers."""
    df = neighbourhood.with_io_mask(rasters.event_grid(spark, sf_dir), 30, 24)
    numbers = F.filter(F.transform("inside", lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    return df.select(*KEYS, F.size(numbers).alias("cells"), F.aggregate(numbers, F.lit(0), lambda s, i: s + i).alias("places"))


# energy


@query(f"""WITH {PAIRS}, m AS ({boxes("pairs", "pair_id", SUMS)}), s AS (SELECT *, greatest((q0 - s0 * s0 / n) / n, 0) AS a, greatest((q1 - s1 * s1 / n) / n, 0) AS b, (c - s0 * s1 / n) / n AS k FROM m)
  SELECT pair_id, y, x, {r("least(greatest(1 - (2 * sqrt(a) * sqrt(b) + 58.5225) / (a + b + 58.5225) * (abs(k) + 29.26125) / (sqrt(a) * sqrt(b) + 29.26125), 0), 1)", "ssim")} FROM s""")
def ssim_cost_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(energy.ssim(_pairs(spark, sf_dir), arranged=True), PAIR, ssim="ssim")


@query(f"""WITH {PAIRS}, m AS ({boxes("pairs", "pair_id", SUMS)}), s AS (SELECT *, greatest((q0 - s0 * s0 / n) / n, 0) AS a, greatest((q1 - s1 * s1 / n) / n, 0) AS b, (c - s0 * s1 / n) / n AS k FROM m)
  SELECT pair_id, y, x, {r("least(greatest((2 * k + 58.5225) / (a + b + 58.5225), 0.25), 1)", "ssim")} FROM s""")
def ssim_similarity_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(energy.ssim(_pairs(spark, sf_dir), "gpu", 0.25, arranged=True), PAIR, ssim="ssim")


@query(f"""WITH {PAIRS}, m AS ({boxes("pairs", "pair_id", SUMS)}), s AS (SELECT *, greatest((q0 - s0 * s0 / n) / n, 0) AS a, greatest((q1 - s1 * s1 / n) / n, 0) AS b, (c - s0 * s1 / n) / n AS k FROM m)
  SELECT pair_id, {r("avg(least(greatest(1 - (2 * sqrt(a) * sqrt(b) + 58.5225) / (a + b + 58.5225) * (abs(k) + 29.26125) / (sqrt(a) * sqrt(b) + 29.26125), 0), 1))", "cost")} FROM s GROUP BY 1""")
def pair_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy of a zero field: similarity alone, as a mean over each pair."""
    terms = energy.ssim(_pairs(spark, sf_dir), arranged=True).withColumns({"ui": F.lit(0.0), "tps": F.lit(0.0)})
    return energy.total_energy(terms).select("pair_id", rounded("energy").alias("cost"))


_POINTS = f"(VALUES {', '.join(map(str, rasters.CONTROL_POINTS))}) AS t(idx, lx, ly, rx, ry)"


@query(f"""WITH {PAIRS}, f AS (SELECT pair_id, y, x, {FIELD} FROM pairs), p AS (SELECT (lx * 8 + rx * 8 - 1) / 2 AS cx, (ly * 8 + ry * 8 - 1) / 2 AS cy, (rx - lx) * 4 AS tx, (ry - ly) * 4 AS ty FROM {_POINTS}),
  h AS (SELECT f.*, (1 - abs(y - cy)) * (1 - abs(x - cx)) AS w, tx, ty FROM f JOIN p ON y BETWEEN floor(cy) AND ceil(cy) AND x BETWEEN floor(cx) AND ceil(cx))
  SELECT pair_id, y, x, {r("sum(w)", "ui_a")}, {r("sum(2 * w * (vx - tx))", "ui_bx")}, {r("sum(2 * w * (vy - ty))", "ui_by")} FROM h GROUP BY ALL""")
def control_point_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(energy.control_point_terms(_field(spark, sf_dir), rasters.control_points(spark), 8, 8), PAIR, ui_a="ui_a", ui_bx="ui_bx", ui_by="ui_by")


_RING = "(VALUES " + ", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, (a, b) in enumerate(zip(neighbourhood.RING, neighbourhood.RING[1:] + neighbourhood.RING[:1]))) + ") AS t(k, ay, ax, ey, ex)"


@query(f"""WITH {PAIRS}, f AS (SELECT pair_id, y, x, {FIELD} FROM pairs), e AS (SELECT f.*, s, k, f.x + s * f.vx AS px, f.y + s * f.vy AS py, s * 0.6 AS gx, s * 0.8 AS gy,
    f.x + ax + s * coalesce(a.vx, f.vx) AS qx, f.y + ay + s * coalesce(a.vy, f.vy) AS qy, f.x + ex + s * coalesce(b.vx, f.vx) AS rx, f.y + ey + s * coalesce(b.vy, f.vy) AS ry
    FROM f CROSS JOIN {_RING} CROSS JOIN (VALUES (-1), (1)) AS u(s) LEFT JOIN f a ON a.pair_id = f.pair_id AND a.y = f.y + ay AND a.x = f.x + ax LEFT JOIN f b ON b.pair_id = f.pair_id AND b.y = f.y + ey AND b.x = f.x + ex),
  d AS (SELECT *, gx * (ry - qy) - gy * (rx - qx) AS det FROM e), t AS (SELECT *, ((qx - px) * (ry - qy) - (qy - py) * (rx - qx)) / nullif(det, 0) AS t, ((qx - px) * gy - (qy - py) * gx) / nullif(det, 0) AS u FROM d)
  SELECT pair_id, y, x, {r("coalesce(greatest(min(CASE WHEN u BETWEEN 0 AND 1 AND t >= 0 THEN t END) - 0.01, 0), 1)", "lim")} FROM t GROUP BY ALL""")
def foldover_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(energy.foldover_limit(_field(spark, sf_dir), F.lit(0.6), F.lit(0.8), arranged=True), PAIR, lim="limit")


# samplers


def _warp_sql(k: str, taps: str, border: str, normalise: bool = False) -> str:
    w = f"{kernel(k).sql('px - floor(px) - i')} * {kernel(k).sql('py - floor(py) - j')}"
    on = "b.y = least(greatest(floor(py) + j, 0), 7) AND b.x = least(greatest(floor(px) + i, 0), 7)" if border == "clamp" else "b.y = floor(py) + j AND b.x = floor(px) + i"
    total = "sum(w * coalesce(b.v, 255))" + (" / sum(w)" if normalise else "")
    return f"""WITH {EMB}, f AS (SELECT image_id, y, x, {FIELD} FROM emb), p AS (SELECT *, x - vx AS px, y - vy AS py FROM f), t AS (SELECT *, {w} AS w FROM p, range({taps}) AS s(j), range({taps}) AS u(i))
      SELECT t.image_id, t.y, t.x, {r(total, "v")} FROM t LEFT JOIN emb b ON b.image_id = t.image_id AND {on} WHERE w <> 0 GROUP BY ALL"""


def _warped(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    img = rasters.embedding_images(spark, sf_dir)
    return told(resample.warp(rasters.synthetic_field(img), img, -1, 8, 8, **how), KEYS, v="v")


@query(_warp_sql("hat", "0, 2", "clamp"))
def warp_bilinear_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warped(spark, sf_dir)


@query(_warp_sql("hat", "0, 2", "fill"))
def warp_bilinear_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warped(spark, sf_dir, border="fill")


@query(_warp_sql("keys4", "-1, 3", "clamp", True))
def warp_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warped(spark, sf_dir, k="keys4", normalise=True)


@query(_warp_sql("bspline3", "-1, 3", "clamp"))
def cubic_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warped(spark, sf_dir, k="bspline3")


def _slopes_sql(order: tuple[int, int], name: str) -> str:
    dx, dy = (kernel("d" * o + ("-" if o else "") + "bspline3") for o in order)
    return f"""WITH {EMB}, f AS (SELECT image_id, y, x, {FIELD} FROM emb), p AS (SELECT *, x + vx AS px, y + vy AS py FROM f),
  t AS (SELECT *, {dx.sql("px - floor(px) - i")} * {dy.sql("py - floor(py) - j")} AS w FROM p, range(-1, 3) AS s(j), range(-1, 3) AS u(i))
  SELECT t.image_id, t.y, t.x, {r("sum(w * b.v)", name)} FROM t JOIN emb b ON b.image_id = t.image_id AND b.y = least(greatest(floor(py) + j, 0), 7) AND b.x = least(greatest(floor(px) + i, 0), 7) WHERE w <> 0 GROUP BY ALL"""


def _slopes(spark: SparkSession, sf_dir: str, order: tuple[int, int], name: str) -> DataFrame:
    img = rasters.embedding_images(spark, sf_dir)
    at = rasters.synthetic_field(img)
    return told(resample.sample(at, img, F.col("x") + F.col("vx"), F.col("y") + F.col("vy"), {name: "v"}, 8, 8, "bspline3", order=order), KEYS, **{name: name})


@query(_slopes_sql((1, 0), "dx"))
def cubic_sampler_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(spark, sf_dir, (1, 0), "dx")


@query(_slopes_sql((1, 1), "dxdy"))
def cubic_sampler_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(spark, sf_dir, (1, 1), "dxdy")


@query(_slopes_sql((0, 2), "dydy"))
def cubic_sampler_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(spark, sf_dir, (0, 2), "dydy")


def _resize_sql(k: str, sizes: tuple[int, int, int, int], mode: str) -> str:
    """Along x, then along y, each output place with its weights by a range of taps."""
    h, w, th, tw = sizes
    kern = kernel(k)

    def one(source: str, axis: str, n: int, m: int) -> str:
        other = "y" if axis == "x" else "x"
        ratio = n / m
        wide = max(ratio, 1.0)
        half = wide * kern.support / 2
        ext = f"least(greatest(j, 0), {n - 1})" if mode == "clamp" else f"CASE WHEN ((j % {2 * n}) + {2 * n}) % {2 * n} < {n} THEN ((j % {2 * n}) + {2 * n}) % {2 * n} ELSE {2 * n - 1} - ((j % {2 * n}) + {2 * n}) % {2 * n} END"
        total = "sum(t.w * s.v) / sum(t.w)" if ratio > 1 else "sum(t.w * s.v)"
        taps = f"SELECT o, {ext} AS j, {kern.sql(f'(j - c) / {wide!r}::DOUBLE')} AS w FROM (SELECT CAST(o AS INT) AS o, (o + 0.5) * {ratio!r}::DOUBLE - 0.5 AS c FROM range({m}) AS q(o)) z, range(-{2 * n}, {3 * n}) AS p(j) WHERE j BETWEEN ceil(c - {half!r}::DOUBLE) AND floor(c + {half!r}::DOUBLE)"
        return f"SELECT s.image_id, s.{other}, t.o AS {axis}, {total} AS v FROM {source} s JOIN ({taps}) t ON s.{axis} = t.j GROUP BY ALL"

    return f"WITH {EVT}, wide AS ({one('evt', 'x', w, tw)}), done AS ({one('wide', 'y', h, th)}) SELECT image_id, y, x, {r('v', 'v')} FROM done"


@query(_resize_sql("hat", (30, 24, 45, 36), "clamp"))
def upsample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(resample.upsample(rasters.event_grid(spark, sf_dir), 30, 24, 45, 36, "hat"), KEYS, v="v")


@query(_resize_sql("mitchell_netravali", (30, 24, 45, 36), "clamp"))
def upsample_mitchell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(resample.upsample(rasters.event_grid(spark, sf_dir), 30, 24, 45, 36, "mitchell_netravali"), KEYS, v="v")


@query(_resize_sql("bspline3", (30, 24, 15, 12), "mirror"))
def downsample_bspline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before the prefilter."""
    return told(lines.scale(rasters.event_grid(spark, sf_dir), 30, 24, 15, 12, "bspline3"), KEYS, v="v")


@query(f"WITH {EVT} SELECT image_id, y // 3 AS y, x // 3 AS x, {r('avg(v)', 'v')} FROM evt GROUP BY ALL")
def downsample_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(resample.area_average(rasters.event_grid(spark, sf_dir), 3), KEYS, v="v")


@query(f"""WITH {EVT}, t AS (SELECT image_id, v, CAST(cy AS INT) AS cy, CAST(cx AS INT) AS cx, {kernel("bspline3").sql("cy - ((y + 0.5) / 2 - 0.5)")} * {kernel("bspline3").sql("cx - ((x + 0.5) / 2 - 0.5)")} AS w FROM evt, range(15) AS a(cy), range(12) AS b(cx)
  WHERE abs(cy - ((y + 0.5) / 2 - 0.5)) <= 2 AND abs(cx - ((x + 0.5) / 2 - 0.5)) <= 2) SELECT image_id, cy AS y, cx AS x, {r("sum(w * v) / sum(w)", "v")} FROM t GROUP BY ALL""")
def downsample_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted partial sums by cell, merged and divided."""
    return told(resample.downsample_cells(rasters.event_grid(spark, sf_dir), 30, 24, 15, 12), KEYS, v="v")


_SIZES = "sizes AS MATERIALIZED (SELECT p_size, count(*) AS n, (p_size - 25.5::DOUBLE) / 6 AS place FROM part GROUP BY p_size)"


@query(f"WITH {_SIZES} " + " UNION ALL ".join(f"SELECT '{n}' AS kernel, p_size, n, {r(k.sql('place'), 'v')} FROM sizes" for n, k in sorted(KERNELS.items())))
def kernel_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kernel of the catalogue at places that the sizes of parts give."""
    sizes = rasters.table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    place = (F.col("p_size") - 25.5) / 6
    parts = [sizes.select(F.lit(n).alias("kernel"), "p_size", "n", rounded(k.value(place)).alias("v")) for n, k in sorted(KERNELS.items())]
    return reduce(DataFrame.union, parts)  # a stage for each kernel: all in one are too much code for a stage


_TAPS = ", ".join(f"('{n}', {k}, {w!r}::DOUBLE)" for n in filters.NAMES for k, w in filters.taps(n))


@query(f"""WITH {EVT}, taps AS (SELECT * FROM (VALUES {_TAPS}) AS t(filter, k, w))
  SELECT filter, image_id, y, {r("sum(w * v)", "first", 10)} FROM taps JOIN evt ON x = CASE WHEN k < 0 THEN -1 - k ELSE k END GROUP BY ALL""")
def filter_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filter of the catalogue, applied to the first place of each line of an image."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: c["v"])
    whole = rasters.event_grid(spark, sf_dir).groupBy("image_id", "y").agg(line.alias("line"))
    all_ = F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in filters.taps(n))).alias("taps")) for n in filters.NAMES)))
    each = whole.select("image_id", "y", "line", all_.alias("f")).select("f.filter", "image_id", "y", "line", "f.taps")
    first = F.aggregate("taps", F.lit(0.0), lambda s, t: s + t["w"] * F.get("line", F.when(t["k"] < 0, -1 - t["k"]).otherwise(t["k"])))
    return each.select("filter", "image_id", "y", rounded(first, 10).alias("first"))


@query("SELECT p_partkey, levels FROM (SELECT p_partkey, CAST(greatest(1, floor(log2(least(8 + p_partkey % 192, 8 + p_size * 6)) - 3) + 1) AS INT) AS levels FROM part)")
def level_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of images whose sides the keys and sizes of parts give."""
    parts = rasters.table(spark, sf_dir, "part")
    return parts.select("p_partkey", resample.levels_of(8 + F.col("p_size") * 6, 8 + F.col("p_partkey") % 192).alias("levels"))


@query(None)
def vector_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(resample.upsample_field(_field(spark, sf_dir).select(*PAIR, "vx", "vy"), 8, 8, 16, 12), PAIR, vx="vx", vy="vy")


@query(None)
def pyramid_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(resample.build_pyramid(rasters.event_grid(spark, sf_dir), 30, 24), ("image_id", "level", "y", "x"), 4, v="v")


@query(None)
def pyramid_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(resample.build_pyramid(rasters.event_grid(spark, sf_dir), 30, 24, variant="gpu"), ("image_id", "level", "y", "x"), 4, v="v")


# filters along lines


def _taps_sql(taps: list[tuple[int, float]], ext: str, digits: int = 6) -> str:
    rows = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in taps)
    one = lambda source, axis, n: f"SELECT a.image_id, a.y, a.x, sum(w * b.v) AS v FROM {source} a CROSS JOIN (VALUES {rows}) AS t(k, w) JOIN {source} b ON b.image_id = a.image_id AND b.{'y' if axis == 'x' else 'x'} = a.{'y' if axis == 'x' else 'x'} AND b.{axis} = {ext.format(f'(a.{axis} + k)', n, 2 * n)} GROUP BY ALL"
    return f"WITH {EVT}, wide AS ({one('evt', 'x', 24)}), done AS ({one('wide', 'y', 30)}) SELECT image_id, y, x, {r('v', 'v', digits)} FROM done"


_SMOOTH = [(-2, 0.0625), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625)]


@query(_taps_sql(_SMOOTH, "least(greatest({0}, 0), {1} - 1)"))
def convolve_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(lines.convolve(rasters.event_grid(spark, sf_dir), _SMOOTH), KEYS, v="v")


@query(_taps_sql(filters.taps("a_bspline3"), "CASE WHEN {0} < 0 THEN -1 - {0} WHEN {0} >= {1} THEN {2} - 1 - {0} ELSE {0} END", 4))
def fir_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(lines.fir(rasters.event_grid(spark, sf_dir), filters.taps("a_bspline3")), KEYS, 4, v="v")


@query(f"WITH {EVT} SELECT image_id, y, x, {r('v', 'v', 4)} FROM evt")
def ifir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter and its inverse: what came in comes out."""
    taps = filters.sampled("bspline3")
    return told(lines.ifir(lines.fir(rasters.event_grid(spark, sf_dir), taps), taps), KEYS, 4, v="v")


_SCAN = """, {name} AS (SELECT a.image_id, a.y, a.x, sum(b.v * 0.5 * pow(0.5, abs(a.{axis} - b.{axis}))) AS v FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND a.{other} = b.{other} AND b.{axis} {op} a.{axis} GROUP BY ALL)"""


@query("WITH " + EVT + "".join(_SCAN.format(name=n, source=s, axis=a, other="y" if a == "x" else "x", op=o) for n, s, a, o in (("s1", "evt", "x", "<="), ("s2", "s1", "x", ">="), ("s3", "s2", "y", "<="), ("s4", "s3", "y", ">="))) + f" SELECT image_id, y, x, {r('v', 'v')} FROM s4")
def iir_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order one with nothing beyond the border; the SQL sums the whole response."""
    return told(lines.recursive_filter(rasters.event_grid(spark, sf_dir), (0.5, 0.5)), KEYS, v="v")


@query(None)
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(lines.gaussian_blur(rasters.event_grid(spark, sf_dir), 2.0), KEYS, 4, v="v")


# solvers


_SLOPES = f"""WITH {PAIRS}, f AS (SELECT pair_id, y, x, {FIELD} FROM pairs), g AS (SELECT f.pair_id, f.y, f.x, f.vx, f.vy, coalesce(f.vx - l.vx, q.vx - f.vx) AS xx, coalesce(f.vy - l.vy, q.vy - f.vy) AS yx, coalesce(f.vx - u.vx, d.vx - f.vx) AS xy, coalesce(f.vy - u.vy, d.vy - f.vy) AS yy FROM f
  LEFT JOIN f l ON l.pair_id = f.pair_id AND l.y = f.y AND l.x = f.x - 1 LEFT JOIN f q ON q.pair_id = f.pair_id AND q.y = f.y AND q.x = f.x + 1
  LEFT JOIN f u ON u.pair_id = f.pair_id AND u.x = f.x AND u.y = f.y - 1 LEFT JOIN f d ON d.pair_id = f.pair_id AND d.x = f.x AND d.y = f.y + 1),
  s AS (SELECT *, sqrt((1 - xx) * (1 - xx) + yx * yx) AS a0, sqrt((1 + xx) * (1 + xx) + yx * yx) AS a1, sqrt(xy * xy + (1 - yy) * (1 - yy)) AS b0, sqrt(xy * xy + (1 + yy) * (1 + yy)) AS b1 FROM g),
  m AS (SELECT *, CASE WHEN a0 > 0 THEN (1 - xx) / a0 ELSE 0 END + CASE WHEN a1 > 0 THEN (1 + xx) / a1 ELSE 0 END AS mx, CASE WHEN a0 > 0 THEN -yx / a0 ELSE 0 END + CASE WHEN a1 > 0 THEN yx / a1 ELSE 0 END AS my,
    CASE WHEN b0 > 0 THEN -xy / b0 ELSE 0 END + CASE WHEN b1 > 0 THEN xy / b1 ELSE 0 END AS nx, CASE WHEN b0 > 0 THEN (1 - yy) / b0 ELSE 0 END + CASE WHEN b1 > 0 THEN (1 + yy) / b1 ELSE 0 END AS ny FROM s),
  j AS (SELECT pair_id, y, x, vx, vy, coalesce(mx / nullif(sqrt(mx * mx + my * my), 0) * sqrt(a0 * a1), 0) AS tax, coalesce(my / nullif(sqrt(mx * mx + my * my), 0) * sqrt(a0 * a1), 0) AS tay,
    coalesce(nx / nullif(sqrt(nx * nx + ny * ny), 0) * sqrt(b0 * b1), 0) AS tbx, coalesce(ny / nullif(sqrt(nx * nx + ny * ny), 0) * sqrt(b0 * b1), 0) AS tby FROM m)"""


@query(f"{_SLOPES} SELECT pair_id, y, x, {r('tax', 'tax', 4)}, {r('tay', 'tay', 4)}, {r('tbx', 'tbx', 4)}, {r('tby', 'tby', 4)} FROM j")
def jacobian_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(solvers.jacobian_average(_field(spark, sf_dir), arranged=True), PAIR, 4, tax="tax", tay="tay", tbx="tbx", tby="tby")


_RIGHT_X = "CASE WHEN a.x > 0 THEN a.tax - 1 ELSE 0 END + CASE WHEN a.y > 0 THEN a.tbx ELSE 0 END - coalesce(q.tax - 1, 0) - coalesce(d.tbx, 0)"
_RIGHT_Y = "CASE WHEN a.x > 0 THEN a.tay ELSE 0 END + CASE WHEN a.y > 0 THEN a.tby - 1 ELSE 0 END - coalesce(q.tay, 0) - coalesce(d.tby - 1, 0)"
_NEXT = "FROM j a LEFT JOIN j q ON q.pair_id = a.pair_id AND q.y = a.y AND q.x = a.x + 1 LEFT JOIN j d ON d.pair_id = a.pair_id AND d.x = a.x AND d.y = a.y + 1"


@query(f"""{_SLOPES} SELECT a.pair_id, a.y * 8 + a.x AS row, {r("greatest(1 - sqrt(a.vx * a.vx + a.vy * a.vy), 0) + (a.x > 0)::INT + (a.x < 7)::INT + (a.y > 0)::INT + (a.y < 7)::INT", "diagonal", 4)},
  {r(_RIGHT_X, "bx", 4)}, {r(_RIGHT_Y, "b_y", 4)} {_NEXT}""")
def path_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, right = solvers.path_system(solvers.jacobian_average(_field(spark, sf_dir), arranged=True), 8, 8)
    both = matrix.where("row = col").select("pair_id", "row", rounded("value", 4).alias("diagonal")).join(right, ["pair_id", "row"])
    return both.select("pair_id", "row", "diagonal", rounded("bx", 4).alias("bx"), rounded("by", 4).alias("b_y"))


def _path_inverse(n: int = 8) -> str:
    """The inverse of the path's matrix for the field of FIELD, by elimination, as rows (i, j, w)."""
    matrix = np.zeros((n * n, n * n))
    for y in range(n):
        for x in range(n):
            vx, vy = ((3 * x + 5 * y) % 7 - 3) / 4, ((5 * x + 3 * y) % 7 - 3) / 4
            matrix[y * n + x, y * n + x] += max(0.0, 1 - np.hypot(vx, vy))
            for to in ((y, x + 1), (y + 1, x)):
                if max(to) < n:
                    for a, b in (((y, x), to), (to, (y, x))):
                        matrix[a[0] * n + a[1], a[0] * n + a[1]] += 1
                        matrix[a[0] * n + a[1], b[0] * n + b[1]] -= 1
    return ", ".join(f"({i}, {j}, {float(w)!r}::DOUBLE)" for (i, j), w in np.ndenumerate(np.linalg.inv(matrix)))


@query(f"""{_SLOPES}, b AS (SELECT a.pair_id, a.y * 8 + a.x AS row, {_RIGHT_X} AS bx, {_RIGHT_Y} AS b_y {_NEXT})
  SELECT pair_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, {r("sum(w * bx)", "ux", 4)}, {r("sum(w * b_y)", "uy", 4)} FROM b JOIN (VALUES {_path_inverse()}) AS t(i, j, w) ON j = row GROUP BY pair_id, i""")
def cg_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(solvers.quadratic_path(_field(spark, sf_dir), 8, 8, 1e-11), PAIR, 4, ux="ux", uy="uy")


@query(None)
def coarse_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = [p[1:] for p in rasters.CONTROL_POINTS]
    return told(solvers.coarse_solve(_pairs(spark, sf_dir), points, 8, 8, "border"), PAIR, 4, vx="vx", vy="vy")


@query(f"""WITH {EMB} SELECT g.image_id, g.y, g.x, {r("coalesce(v, 255)", "v")}, 255 AS a, v IS NOT NULL AS held FROM (SELECT image_id, CAST(i // 10 AS INT) AS y, CAST(i % 10 AS INT) AS x FROM (SELECT DISTINCT image_id FROM emb), range(100) AS t(i)) g
  LEFT JOIN emb e ON e.image_id = g.image_id AND e.y + 1 = g.y AND e.x + 1 = g.x""")
def extended_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.extended_canvas(rasters.embedding_images(spark, sf_dir), 8, 8).select(*KEYS, rounded("v").alias("v"), "a", "held")


@query(None)
def filled_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    canvas = solvers.extended_canvas(rasters.embedding_images(spark, sf_dir), 8, 8)
    return told(solvers.filled_margin(canvas, 1e-12), KEYS, 4, v="v")


@query(None)
def morph_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halfway fields of all pairs of embeddings, from 4 by 4 to 8 by 8."""
    return told(matching.match(_pairs(spark, sf_dir), matching.Settings(start_res=4)), PAIR, 4, vx="vx", vy="vy")


# contours


_SIDES = {0: ("n.v + ne.v - s.v - se.v", "4"), 1: ("e.v - n.v", "sqrt(2)"), 2: ("nw.v + w.v - e.v - ne.v", "4"), 3: ("w.v - n.v", "sqrt(2)"), 4: ("n.v + nw.v - s.v - sw.v", "4"), 5: ("w.v - s.v", "sqrt(2)"), 6: ("w.v + sw.v - e.v - se.v", "4"), 7: ("e.v - s.v", "sqrt(2)")}
_COSTS = f"""WITH {EVT}, w8 AS (SELECT a.image_id, a.y, a.x, {", ".join(f"{k} AS l{d}" for d, k in ((d, f"coalesce(abs(({a}) / {b}), 0)") for d, (a, b) in _SIDES.items()))} FROM evt a
  {" ".join(f"LEFT JOIN evt {n} ON {n}.image_id = a.image_id AND {n}.y = a.y + ({dy}) AND {n}.x = a.x + ({dx}) AND a.y BETWEEN 1 AND 28 AND a.x BETWEEN 1 AND 22" for n, (dy, dx) in zip(("e", "ne", "n", "nw", "w", "sw", "s", "se"), graph.DIRECTIONS))}),
  links AS ({" UNION ALL ".join(f"SELECT image_id, y, x, {d} AS dir, l{d} AS link FROM w8" for d in range(8))})"""


@query(f"{_COSTS}, t AS (SELECT image_id, max(link) AS top FROM links GROUP BY 1) SELECT image_id, y, x, dir, {r('link', 'link')}, {r('(top - link) * CASE WHEN dir % 2 = 0 THEN 1 ELSE sqrt(2) END', 'cost')} FROM links JOIN t USING (image_id)")
def edge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = graph.edge_costs(rasters.event_grid(spark, sf_dir), ("v",))
    return told(graph.inverted(links), (*KEYS, "dir"), link="link", cost="cost")


_DIRS = "(VALUES " + ", ".join(f"({d}, {dy}, {dx})" for d, (dy, dx) in enumerate(graph.DIRECTIONS)) + ") AS t(dir, dy, dx)"


@query(f"WITH {EVT} SELECT image_id, y, x, dir, y + dy AS ny, x + dx AS nx FROM evt, {_DIRS} WHERE y + dy BETWEEN 0 AND 29 AND x + dx BETWEEN 0 AND 23")
def neighbour_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = graph.edge_costs(rasters.event_grid(spark, sf_dir), ("v",))
    return graph.neighbour_list(links, 30, 24).select(*KEYS, "dir", "ny", "nx")


@query(None)
def livewire_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = graph.inverted(graph.edge_costs(rasters.event_grid(spark, sf_dir), ("v",)))
    return graph.livewire(costs, (3, 3), (26, 20)).withColumn("distance", rounded("distance", 4))


_POLYGONS = {1: [(2.5, 2.5), (15.5, 4.5), (11.5, 20.5)], 2: [(10.5, 10.5), (20.5, 10.5), (20.5, 25.5), (10.5, 25.5)]}


def _crossings(corners: list[tuple[float, float]]) -> str:
    parts = [f"(y >= {min(a[1], b[1])} AND y < {max(a[1], b[1])} AND x < {a[0]} + (y - {a[1]}) * ({b[0] - a[0]}) / ({b[1] - a[1]}))::INT" for a, b in zip(corners, corners[1:] + corners[:1]) if a[1] != b[1]]
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query(f"WITH {EVT} SELECT image_id, y, x, CASE WHEN a OR b THEN 255 ELSE 0 END AS ignore, CASE WHEN a OR b THEN 255 ELSE 0 END AS parent_outside, CASE WHEN a OR b THEN 0 ELSE 255 END AS new_outside FROM (SELECT *, {_crossings(_POLYGONS[1])} AS a, {_crossings(_POLYGONS[2])} AS b FROM evt)")
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.polygon_masks(rasters.event_grid(spark, sf_dir), _POLYGONS).select(*KEYS, "ignore", "parent_outside", "new_outside")


# frames


def _tap(sign: str, source: str) -> str:
    return f"""SELECT p.pair_id, p.y, p.x, sum((1 - abs(px - floor(px) - i)) * (1 - abs(py - floor(py) - j)) * b.{source}) AS c FROM (SELECT *, x {sign} vx AS px, y {sign} vy AS py FROM f) p, range(2) AS s(j), range(2) AS u(i), pairs b
      WHERE px >= 0 AND px < 8 AND py >= 0 AND py < 8 AND b.pair_id = p.pair_id AND b.y = least(floor(py) + j, 7) AND b.x = least(floor(px) + i, 7) GROUP BY ALL"""


@query(f"""WITH {PAIRS}, f AS (SELECT pair_id, y, x, {FIELD} FROM pairs), a AS ({_tap("-", "v0")}), b AS ({_tap("+", "v1")})
  SELECT f.pair_id, f.y, f.x, {r("CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN (a.c + b.c) / 2 ELSE coalesce(a.c, b.c, 255) END", "v")} FROM f LEFT JOIN a USING (pair_id, y, x) LEFT JOIN b USING (pair_id, y, x)""")
def halfway_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    images = [pairs.select(*PAIR, F.col(c).alias("v")) for c in ("v0", "v1")]
    return told(render.halfway(_field(spark, sf_dir).select(*PAIR, "vx", "vy"), *images, 8, 8), PAIR, v="v")


_ALPHA = "CASE WHEN x < 3 AND z = 0 THEN 0 WHEN z = 1 AND y > 4 THEN 51 ELSE 255 END"


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rasters.embedding_images(spark, sf_dir)
    alpha = F.when((F.col("x") < 3) & (F.col("z_order") == 0), 0).when((F.col("z_order") == 1) & (F.col("y") > 4), 51).otherwise(255)
    two = df.select(F.expr("image_id div 2").alias("image_id"), "y", "x", "v", (F.col("image_id") % 2).cast("int").alias("z_order"))
    return two.withColumn("a", alpha)


@query(f"""WITH {EMB}, l AS (SELECT image_id // 2 AS image_id, y, x, v, image_id % 2 AS z FROM emb), a AS (SELECT *, {_ALPHA} / 255.0::DOUBLE AS k FROM l),
  m AS (SELECT image_id, y, x, {", ".join(f"max({c}) FILTER (z = {z}) AS {c}{z}" for z in (0, 1) for c in "vk")} FROM a GROUP BY ALL HAVING count(*) = 2)
  SELECT image_id, y, x, {r("(255 * k0 + v0 * (1 - k0)) * k1 + v1 * (1 - k1)", "v")} FROM m""")
def layer_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(render.composited(_layers(spark, sf_dir)), KEYS, v="v")


@query(f"""WITH {EMB}, l AS (SELECT image_id // 2 AS image_id, y, x, v, image_id % 2 AS z FROM emb), a AS (SELECT *, {_ALPHA} AS k FROM l)
  SELECT image_id, y, x, {r("coalesce(max(CASE WHEN k = 0 THEN v * (z + 1) / 2 END), 255)", "v")} FROM a GROUP BY ALL""")
def layer_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(render.layer_preview(_layers(spark, sf_dir), 2), KEYS, v="v")


@query(f"""WITH {EMB}, l AS (SELECT image_id // 2 AS image_id, y, x, image_id % 2 AS z FROM emb), a AS (SELECT *, {_ALPHA} AS k FROM l) SELECT image_id, CAST(min(z) AS INT) AS z_order FROM a WHERE k = 0 AND y = 5 AND x = 1 GROUP BY 1""")
def pick_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.picked_layer(_layers(spark, sf_dir), 5, 1)


@query(f"WITH {EMB} SELECT image_id, y, x, {r('least(greatest(v / 200 - 0.1, 0), 1) * 255', 'v')} FROM emb")
def error_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(rasters.embedding_images(spark, sf_dir), KEYS, v=render.error_image(F.col("v") / 200 - 0.1))


@query("""SELECT event_type, CAST(user_id % 200 AS INT) AS tick, count(*) AS n, CAST(CASE WHEN user_id % 200 % 80 <= 40 THEN 30 + user_id % 200 % 80 ELSE 110 - user_id % 200 % 80 END AS INT) AS percent
  FROM events GROUP BY ALL""")
def frame_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of the way at ticks that users' numbers give."""
    ticks = rasters.table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 200).cast("int").alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    return ticks.select("event_type", "tick", "n", render.frame_at(F.col("tick"), 20).cast("int").alias("percent"))


@query(None)
def morph_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _field(spark, sf_dir).withColumns({"ux": F.col("vx") / 4, "uy": F.col("vy") / 4})
    return told(render.morph_frames(pairs, [0.0, 0.25, 0.5, 1.0]), ("pair_id", "frame", "y", "x"), 3, v="v")


# reports


@query(f"""WITH {EVT} SELECT image_id, y * 24 + x AS line, printf('%.6f %.6f', ((3 * x + 5 * y) % 7 - 3) / 4.0, ((5 * x + 3 * y) % 7 - 3) / 4.0) AS text FROM evt""")
def vector_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the field's text form."""
    df = rasters.synthetic_field(rasters.event_grid(spark, sf_dir))
    return df.select("image_id", (F.col("y") * 24 + F.col("x")).alias("line"), F.format_string("%.6f %.6f", "vx", "vy").alias("text"))


_TIMES = """times AS (SELECT event_type AS label, user_id % 7 AS part, value AS ms FROM events)"""


@query(f"""WITH {_TIMES}, s AS (SELECT label, part, count(*) AS runs, sum(ms) AS ms FROM times GROUP BY ALL) SELECT label, CAST(part AS INT) AS part, runs, {r("ms / 1000", "sec", 6)},
  {r("100 * ms / nullif(sum(ms) OVER (PARTITION BY label), 0)", "percent", 3)}, {r("1000 * runs / nullif(ms, 0)", "rate", 2)} FROM s""")
def timer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings by label and part: how often, seconds, the share of the label's whole, and runs a second."""
    df = rasters.table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), (F.col("user_id") % 7).cast("int").alias("part"), F.col("value").alias("ms"))
    sums = df.groupBy("label", "part").agg(F.count(F.lit(1)).alias("runs"), F.sum("ms").alias("ms"))
    none = F.lit(0.0)
    share = 100 * F.col("ms") / F.nullif(F.sum("ms").over(Window.partitionBy("label")), none)
    rate = 1000 * F.col("runs") / F.nullif(F.col("ms"), none)  # null where nothing took any time
    return sums.withColumn("share", share).select("label", "part", "runs", rounded(F.col("ms") / 1000, 6).alias("sec"), rounded("share", 3).alias("percent"), rounded(rate, 2).alias("rate"))


@query(f"""WITH {EVT} SELECT image_id, {r("sum(CASE WHEN v > 20 THEN 1 ELSE 0 END) / count(*)", "done")} FROM evt GROUP BY 1""")
def progress_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work done by all work, in pixels."""
    done = F.sum(F.when(F.col("v") > 20, 1).otherwise(0)) / F.count(F.lit(1))
    return rasters.event_grid(spark, sf_dir).groupBy("image_id").agg(rounded(done).alias("done"))


