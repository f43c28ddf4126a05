"""Queries of the pixel functions, over rasters from embeddings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.functions import pixels as P
from rastrel.functions import vectors as V
from rastrel.operators import neighbourhood, render, resample
from rastrel.plans.base import EMB, EVT, RGB, query, r, rounded, told
from rastrel.sources import rasters

KEYS = ("image_id", "y", "x")
SAT = "least(greatest({}, 0), 1)"


@query(f"WITH {EMB} SELECT image_id, y, x, {r('v', 'v')} FROM emb")
def raster_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(rasters.embedding_images(spark, sf_dir), KEYS, v="v")


@query(f"WITH {EVT} SELECT image_id, y, x, {r('v', 'v')} FROM evt")
def event_density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(rasters.event_grid(spark, sf_dir), KEYS, v="v")


@query(f"""SELECT g.image_id, g.y, g.x, {r("coalesce(p, 0)", "v", 2)} FROM
  (SELECT image_id, CAST(i // 11 AS INT) AS y, CAST(i % 11 AS INT) AS x FROM (SELECT DISTINCT l_returnflag || l_linestatus AS image_id FROM lineitem), range(550) AS t(i)) g
  LEFT JOIN (SELECT l_returnflag || l_linestatus AS image_id, CAST(l_quantity AS INT) - 1 AS y, CAST(round(l_discount * 100) AS INT) AS x, sum(l_extendedprice) AS p FROM lineitem GROUP BY ALL) s
  ON g.image_id = s.image_id AND g.y = s.y AND g.x = s.x""")
def lineitem_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(rasters.lineitem_grid(spark, sf_dir), KEYS, 2, v="v")


@query(f"WITH {RGB} SELECT image_id, y, x, {r('r', 'r')}, {r('g', 'g')}, {r('b', 'b')} FROM rgb")
def channel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(rasters.embedding_rgb(spark, sf_dir), KEYS, r="r", g="g", b="b")


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.embedding_rgb(spark, sf_dir)


RED, GREEN, BLUE, VALUE = (lambda: F.col("r")), (lambda: F.col("g")), (lambda: F.col("b")), (lambda: F.col("v"))


def _three(names: str, exprs: list[str]) -> str:
    return ", ".join(r(e, n) for n, e in zip(names.split(), exprs))


def _matrix(rows: tuple, a: str = "r", b: str = "g", c: str = "b") -> list[str]:
    return [f"({x!r}::DOUBLE * ({a}) + {y!r}::DOUBLE * ({b}) + {z!r}::DOUBLE * ({c}))" for x, y, z in rows]


@query(f"WITH {RGB} SELECT image_id, y, x, CAST(floor(r * 255.0 + 0.5) AS SMALLINT) AS byte, {r('floor(r * 255.0 + 0.5) / 255.0', 'back')}, CAST(trunc(r * 200) AS SMALLINT) AS cut FROM rgb")
def type_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = P.to_byte(F.col("r"))
    return _rgb(spark, sf_dir).select(*KEYS, byte.alias("byte"), rounded(P.to_float(byte)).alias("back"), P.to_byte(F.col("r") * 200, rescale=False).alias("cut"))


@query(f"WITH {RGB} SELECT image_id, y, x, {r('0.2126 * r + 0.7152 * g + 0.0722 * b', 'gray')}, {r('0.299 * r + 0.587 * g + 0.114 * b', 'luma')} FROM rgb")
def grayscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = RED(), GREEN(), BLUE()
    return told(_rgb(spark, sf_dir), KEYS, gray=P.grayscale(*c), luma=P.luminance(*c))


@query(f"""WITH {RGB} SELECT image_id, y, x, {r("CASE WHEN r <= 0.0031308 THEN 12.92 * r ELSE 1.055 * pow(r, 1 / 2.4::DOUBLE) - 0.055 END", "up")},
  {r("CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END", "down")} FROM rgb""")
def srgb_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(_rgb(spark, sf_dir), KEYS, up=P.linear_to_srgb(RED()), down=P.srgb_to_linear(RED()))


@query(f"""WITH {RGB} SELECT image_id, y, x, {r("CASE WHEN r <= 0.0031308 THEN 12.92 * r ELSE 1.055 * sqrt(r) - 0.055 END", "up")},
  {r("CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2) END", "down")} FROM rgb""")
def srgb_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(_rgb(spark, sf_dir), KEYS, up=P.linear_to_srgb(RED(), fast=True), down=P.srgb_to_linear(RED(), fast=True))


_CURVE = "CASE WHEN {0} > 0.008856 THEN cbrt({0}) ELSE (903.3 * {0} + 16.0) / 116.0 END"


_LAB = f"""{RGB}, xyz AS (SELECT image_id, y, x, {", ".join(f"{e} / {w!r}::DOUBLE AS t{i}" for i, (e, w) in enumerate(zip(_matrix(P._XYZ), P._WHITE)))} FROM rgb),
  f AS (SELECT image_id, y, x, {", ".join(f"{_CURVE.format(f't{i}')} AS f{i}" for i in range(3))} FROM xyz)"""


@query(f"WITH {_LAB} SELECT image_id, y, x, {r('116 * f1 - 16', 'l')}, {r('500 * (f0 - f1)', 'a')}, {r('200 * (f1 - f2)', 'b')} FROM f")
def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    light, a, b = P.rgb_to_lab(RED(), GREEN(), BLUE())
    return told(_rgb(spark, sf_dir), KEYS, l=light, a=a, b=b)


_UNCURVE = "CASE WHEN pow({0}, 3) > 0.008856 THEN pow({0}, 3) ELSE ({0} - 16 / 116.0::DOUBLE) / 7.787 END"


@query(f"""WITH {_LAB}, back AS (SELECT image_id, y, x, {", ".join(f"({_UNCURVE.format(f'f{i}')}) * {w!r}::DOUBLE AS t{i}" for i, w in enumerate(P._WHITE))} FROM f)
  SELECT image_id, y, x, {_three("r g b", _matrix(P._FROM_XYZ, "t0", "t1", "t2"))} FROM back""")
def lab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back, for every pixel."""
    back = P.lab_to_rgb(*P.rgb_to_lab(RED(), GREEN(), BLUE()))
    return told(_rgb(spark, sf_dir), KEYS, **dict(zip("rgb", back)))


@query(f"WITH {RGB} SELECT image_id, y, x, {_three('luma i q', _matrix(P._YIQ))} FROM rgb")
def yiq(spark: SparkSession, sf_dir: str) -> DataFrame:
    luma, i, q = P.rgb_to_yiq(RED(), GREEN(), BLUE())
    return told(_rgb(spark, sf_dir), KEYS, luma=luma, i=i, q=q)


_HSL = f"""{RGB}, m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM rgb),
  hsl AS (SELECT image_id, y, x, (hi + lo) / 2 AS l, CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(hi + lo - 1)) END AS s,
  CASE WHEN hi = lo THEN 0 WHEN hi = r AND g >= b THEN 60 * (g - b) / (hi - lo) WHEN hi = r THEN 360 + 60 * (g - b) / (hi - lo)
  WHEN hi = g THEN 120 + 60 * (b - r) / (hi - lo) ELSE 240 + 60 * (r - g) / (hi - lo) END AS h FROM m)"""


@query(f"WITH {_HSL} SELECT image_id, y, x, {r('h', 'h')}, {r('s', 's')}, {r('l', 'l')} FROM hsl")
def hsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, s, light = P.rgb_to_hsl(RED(), GREEN(), BLUE())
    return told(_rgb(spark, sf_dir), KEYS, h=h, s=s, l=light)


_BACK = "CASE WHEN k < 1 THEN {0} WHEN k < 2 THEN {1} WHEN k < 3 THEN {2} WHEN k < 4 THEN {3} WHEN k < 5 THEN {4} ELSE {5} END + l2 - c / 2"


@query(f"""WITH {_HSL}, moved AS (SELECT image_id, y, x, (h + 40) - 360 * floor((h + 40) / 360) AS h2, least(greatest(s * 1.25, 0), 1) AS s2, least(greatest(l + (1 - l) * 0.05, 0), 1) AS l2 FROM hsl),
  c AS (SELECT *, (1 - abs(2 * l2 - 1)) * s2 AS c, h2 / 60 AS k FROM moved), z AS (SELECT *, c * (1 - abs(k - 2 * floor(k / 2) - 1)) AS z FROM c)
  SELECT image_id, y, x, {r(_BACK.format("c", "z", "0", "0", "z", "c"), "r")}, {r(_BACK.format("z", "c", "c", "z", "0", "0"), "g")}, {r(_BACK.format("0", "0", "z", "c", "c", "z"), "b")} FROM z""")
def hsl_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.adjust_hsl(RED(), GREEN(), BLUE(), 40.0, 25.0, 10.0)
    return told(_rgb(spark, sf_dir), KEYS, **dict(zip("rgb", made)))


@query(f"""WITH {RGB} SELECT image_id, y, x, {r(SAT.format("round_even(r * 4, 0) / 4"), "posterized")}, CASE WHEN r BETWEEN 0.4 AND 0.6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS kept,
  {r("r * 1.5 + 0.25", "scaled")}, {r(SAT.format("0.1 + r * (0.5 + r * (-0.25 + r * 0.75))"), "curved")}, {r("pow(r, 1 / 3.0::DOUBLE)", "rooted")} FROM rgb""")
def point_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterize, threshold, scale and bias, polynomial and root."""
    c = F.col("r")
    return told(
        _rgb(spark, sf_dir), KEYS, posterized=P.posterize(c, 5), kept=P.threshold(c, 0.4, 0.6), scaled=P.bias(P.scale(c, 1.5), 0.25),
        curved=P.polynomial(c, [0.1, 0.5, -0.25, 0.75]), rooted=P.root(c, 3.0),
    )


@query(f"""WITH {RGB}, n AS (SELECT *, abs(r - 0.5) <= 0.1 AND abs(g - 0.5) <= 0.15 AND abs(b - 0.5) <= 0.2 AS near FROM rgb)
  SELECT image_id, y, x, {", ".join(r(f"CASE WHEN near THEN least(greatest({v} + abs({c} - 0.5), 0), 1) ELSE {c} END", c) for c, v in zip("rgb", (0.9, 0.1, 0.3)))} FROM n""")
def replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.replacement((RED(), GREEN(), BLUE()), (0.5, 0.5, 0.5), (0.9, 0.1, 0.3), (0.1, 0.15, 0.2))
    return told(_rgb(spark, sf_dir), KEYS, **dict(zip("rgb", made)))


@query(f"""WITH {RGB} SELECT image_id, y, x, {r(SAT.format("(r + (1 - r) * 0.2 - 0.5) * tan(1.3 * pi() / 4) + 0.5"), "brighter")},
  {r(SAT.format("(r * 0.7 - 0.5) * tan(0.6 * pi() / 4) + 0.5"), "darker")} FROM rgb""")
def brightness_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(_rgb(spark, sf_dir), KEYS, brighter=P.brightness_contrast(RED(), 0.2, 0.3), darker=P.brightness_contrast(RED(), -0.3, -0.4))


@query(f"""WITH {RGB}, e AS (SELECT image_id, min(least(r, g, b)) AS lo, max(greatest(r, g, b)) AS hi FROM rgb GROUP BY 1)
  SELECT image_id, y, x, {", ".join(r(f"({c} - lo) / (hi - lo)", c) for c in "rgb")} FROM rgb JOIN e USING (image_id)""")
def minmax_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rgb(spark, sf_dir)
    ends = df.groupBy("image_id").agg(F.min(F.least("r", "g", "b")).alias("lo"), F.max(F.greatest("r", "g", "b")).alias("hi"))
    spread = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return told(df.join(ends, "image_id"), KEYS, **{c: (F.col(c) - F.col("lo")) / spread for c in "rgb"})


@query(f"""WITH {RGB}, l AS (SELECT *, {_matrix(P._YIQ)[0]} AS luma, {_matrix(P._YIQ)[1]} AS i, {_matrix(P._YIQ)[2]} AS q FROM rgb),
  s AS (SELECT a.image_id, a.y, a.x, avg(b.luma) AS blurred FROM l a JOIN l b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY ALL),
  n AS (SELECT l.image_id, l.y, l.x, i, q, luma + luma * 0.8 * CASE WHEN luma - blurred < 0.05 THEN pow(luma - blurred, 2) ELSE luma - blurred END AS luma FROM l JOIN s USING (image_id, y, x))
  SELECT image_id, y, x, {", ".join(r(e, c) for c, e in zip("rgb", _matrix(P._RGB, "luma", "i", "q")))} FROM n""")
def unsharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rgb(spark, sf_dir).withColumn("luma", P.luminance(RED(), GREEN(), BLUE()))
    df = neighbourhood.box(df, {"total": F.col("luma"), "n": F.lit(1)}, arranged=True)
    made = P.unsharp(RED(), GREEN(), BLUE(), F.col("total") / F.col("n"), 0.8, 0.05)
    return told(df, KEYS, **dict(zip("rgb", made)))


_DERIVED = f"""{EMB}, g AS (SELECT image_id, y, x, v / 255.0 AS v FROM emb),
  h AS (SELECT *, coalesce(lag(v) OVER row_, v) AS l, coalesce(lead(v) OVER row_, v) AS rr FROM g WINDOW row_ AS (PARTITION BY image_id, y ORDER BY x)),
  d AS (SELECT *, coalesce(lag(v) OVER col_, v) AS u, coalesce(lead(v) OVER col_, v) AS dn, coalesce(lag(l) OVER col_, l) AS ul, coalesce(lag(rr) OVER col_, rr) AS ur,
    coalesce(lead(l) OVER col_, l) AS dl, coalesce(lead(rr) OVER col_, rr) AS dr FROM h WINDOW col_ AS (PARTITION BY image_id, x ORDER BY y)),
  der AS MATERIALIZED (SELECT image_id, y, x, v, (rr - l) / 2 AS dx, (dn - u) / 2 AS dy, rr - 2 * v + l AS dxx, dn - 2 * v + u AS dyy, (dr - dl - ur + ul) / 4 AS dxy FROM d)"""


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.embedding_images(spark, sf_dir).withColumn("v", F.col("v") / 255.0)


@query(f"""WITH {_DERIVED} SELECT image_id, y, x, {r("dx", "dx")}, {r("dy", "dy")}, {r("dxx", "dxx")}, {r("dyy", "dyy")}, {r("dxy", "dxy")},
  {r(SAT.format("sqrt(dx * dx + dy * dy)"), "edge")}, {r(SAT.format("dxx + dyy"), "laplacian")}, {r(SAT.format("v - 0.5 * (dxx + dyy)"), "enhanced")} FROM der""")
def derivative_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient edge, Laplacian and Laplace enhancement over central differences."""
    df = neighbourhood.derivatives(_unit(spark, sf_dir), arranged=True)
    dx, dy, dxx, dyy = (F.col(c) for c in ("dx", "dy", "dxx", "dyy"))
    return told(df, KEYS, dx="dx", dy="dy", dxx="dxx", dyy="dyy", dxy="dxy", edge=P.gradient_edge(dx, dy), laplacian=P.laplacian(dxx, dyy), enhanced=P.laplace_enhancement(VALUE(), dxx, dyy, 0.5))


_ERF = "(1 - (k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))) * exp(-t * t))"


@query(f"""WITH {_DERIVED}, p AS (SELECT *, dx * dx + dy * dy AS n2, sqrt(dx * dx + dy * dy) * 3.0 / 0.5 AS t FROM der), k AS (SELECT *, 1 / (1 + 0.3275911 * t) AS k FROM p),
  gs AS (SELECT *, CASE WHEN t < 1e-6 THEN 1 / 6.0::DOUBLE ELSE t * exp(-t * t) / (3 * 1.77245385 * {_ERF}) END AS g FROM k),
  f AS (SELECT *, CASE WHEN t < 1e-6 THEN 1 / 6.0::DOUBLE ELSE 3 * g + (3 * g - 0.5) / (t * t) END AS f FROM gs)
  SELECT image_id, y, x, {r(SAT.format("v + 9 * CASE WHEN n2 = 0 THEN (dxx + dyy) / 6 ELSE f * (dx * dx * dxx + 2 * dx * dy * dxy + dy * dy * dyy) / n2 + g * (dy * dy * dxx - 2 * dx * dy * dxy + dx * dx * dyy) / n2 END"), "v", 4)} FROM f""")
def yaroslavsky(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = neighbourhood.derivatives(_unit(spark, sf_dir), arranged=True)
    made = P.yaroslavsky(VALUE(), *(F.col(c) for c in ("dx", "dy", "dxx", "dxy", "dyy")), 3.0, 0.5)
    return told(df, KEYS, 4, v=made)


@query(f"""WITH {EMB}, t AS (SELECT image_id, y, x, v, v / 255 * 4 - 2 AS t FROM emb)
  SELECT image_id, y, x, {r("CASE WHEN t < 0 THEN 0 WHEN t > 1 THEN 1 ELSE t * t * (3 - 2 * t) END", "smooth")}, {r("t - floor(t)", "fract")}, {r("10 + (v - 10) * 0.25", "mixed")},
  {r("sqrt(t * t + x * x + y * y)", "len")}, {r("t * x + y * 2", "dots")}, {r("round_even(t, 0)", "rint")}, {r("(t * 3 - y * 2) / 1", "cross_z")},
  {r("CASE WHEN t = 0 THEN NULL ELSE 1 / sqrt(abs(t)) END", "rsqrt", 4)}, {r("t - 2 * (t * 0.6 + x * 0.8) * 0.6", "mirrored")},
  {r("CASE WHEN abs(t) < 1 THEN 1.5 * pow(abs(t), 3) - 2.5 * t * t + 1 WHEN abs(t) < 2 THEN -0.5 * pow(abs(t), 3) + 2.5 * t * t - 4 * abs(t) + 2 ELSE 0 END", "catmull")} FROM t""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shaping, geometry, rounding and power functions, over a ramp of values."""
    df = rasters.embedding_images(spark, sf_dir).withColumn("t", F.col("v") / 255 * 4 - 2)
    t, x, y = F.col("t"), F.col("x").cast("double"), F.col("y").cast("double")
    return df.select(
        *KEYS, rounded(V.smoothstep(t, 0.0, 1.0)).alias("smooth"), rounded(V.fract(t)).alias("fract"), rounded(V.lerp(F.lit(10.0), VALUE(), F.lit(0.25))).alias("mixed"),
        rounded(V.length((t, x, y))).alias("len"), rounded(V.dot((t, y), (x, F.lit(2.0)))).alias("dots"), rounded(F.rint(t)).alias("rint"),
        rounded(V.cross((t, y, F.lit(0.0)), (F.lit(2.0), F.lit(3.0), F.lit(0.0)))[2]).alias("cross_z"), rounded(V.rsqrt(F.abs(t)), 4).alias("rsqrt"),
        rounded(V.reflect((t, x), (F.lit(0.6), F.lit(0.8)))[0]).alias("mirrored"), rounded(V.catmull_rom(t)).alias("catmull"),
    )


_MASKS = "CASE WHEN (x + y) % 5 = 0 THEN 255.0 ELSE 0.0 END AS ignore, CASE WHEN x < 2 THEN 255.0 ELSE 0.0 END AS outside"


@query(f"""WITH {EMB}, m AS (SELECT *, {_MASKS} FROM emb) SELECT image_id, y, x, {r("CASE WHEN ignore = 0 AND outside > 0 THEN 255 ELSE v END", "whitened")},
  {r("CASE WHEN outside > 0 THEN 255 ELSE v * (1 - ignore / 510) END", "preview")}, {r("(1 - ignore / 255) * (1 - outside / 255)", "weight")} FROM m""")
def mask_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-out before a level is made smaller, the preview of masks, and the weight of both masks."""
    df = rasters.synthetic_masks(rasters.embedding_images(spark, sf_dir))
    whitened = resample.white_out(df.withColumn("whitened", VALUE()), "whitened", 255.0)
    weight = (1.0 - F.col("ignore") / 255.0) * (1.0 - F.col("outside") / 255.0)
    return told(whitened, KEYS, whitened="whitened", preview=render.mask_preview(VALUE(), F.col("ignore"), F.col("outside")), weight=weight)


@query(f"WITH {EMB} SELECT image_id, min(y * 8 + x) // 8 AS y, min(y * 8 + x) % 8 AS x FROM (SELECT *, {_MASKS} FROM emb) WHERE outside = 0 GROUP BY 1")
def first_layer_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.first_pixel(rasters.synthetic_masks(rasters.embedding_images(spark, sf_dir)))


@query(f"""WITH {EVT} SELECT image_id, y, x, CASE y WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 29 THEN 4 WHEN 28 THEN 3 ELSE 2 END AS class_y, CASE x WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 23 THEN 4 WHEN 22 THEN 3 ELSE 2 END AS class_x,
  x IN (0, 23) AND y IN (0, 29) AS corner, x IN (0, 23) OR y IN (0, 29) AS border FROM evt""")
def border_and_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("y"), F.col("x")
    return rasters.event_grid(spark, sf_dir).select(
        *KEYS, neighbourhood.border_class(y, 30).alias("class_y"), neighbourhood.border_class(x, 24).alias("class_x"), neighbourhood.locked(y, x, 30, 24, "corner").alias("corner"),
        neighbourhood.locked(y, x, 30, 24, "border").alias("border"),
    )


@query("""SELECT l_orderkey, l_linenumber, i AS place, CASE WHEN i BETWEEN 0 AND 6 THEN i END AS by_none, least(greatest(i, 0), 6) AS by_clamp, ((i % 7) + 7) % 7 AS by_repeat,
  CASE WHEN ((i % 14) + 14) % 14 < 7 THEN ((i % 14) + 14) % 14 ELSE 13 - ((i % 14) + 14) % 14 END AS by_mirror FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) - 25 AS i FROM lineitem)""")
def extension_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from 24 before a line of seven to 18 behind it, one for each line item."""
    i = F.col("l_quantity").cast("int") - 25
    rows = rasters.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", i.alias("place"), *(V.extended(i, F.lit(7), m).alias(f"by_{m}") for m in ("none", "clamp", "repeat", "mirror")))
