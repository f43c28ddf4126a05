"""The terms of the matching energy: structural similarity, control points, and the limit that keeps the mesh from folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.functions.vectors import clamp, segment_hit
from rastrel.operators.neighbourhood import RING, moments, one_ring

# The stabilising constants for values of 0 to 255.
C2, C3 = 58.5225, 29.26125


def _statistics(n: Column, s0: Column, s1: Column, q0: Column, q1: Column, c: Column) -> tuple[Column, ...]:
    """Variances (no less than 0) and covariance from sums."""
    n = F.nullif(n, F.lit(0.0))
    m0, m1 = s0 / n, s1 / n
    return F.greatest(F.lit(0.0), (q0 - n * m0 * m0) / n), F.greatest(F.lit(0.0), (q1 - n * m1 * m1) / n), (c - n * m0 * m1) / n


def ssim_cost(n: Column, s0: Column, s1: Column, q0: Column, q1: Column, c: Column, ssim_clamp: float = 0.0) -> Column:
    """1 less contrast times structure (by the size of the covariance), within 0 and 1 - clamp; 0 where a weight of 1 or less is."""
    v0, v1, cov = _statistics(n, s0, s1, q0, q1, c)
    deviation = F.sqrt(v0) * F.sqrt(v1)
    contrast, structure = (2.0 * deviation + C2) / (v0 + v1 + C2), (F.abs(cov) + C3) / (deviation + C3)
    return F.when(n <= 1, 0.0).otherwise(F.least(F.greatest(F.lit(0.0), 1.0 - contrast * structure), F.lit(1.0 - ssim_clamp)))


def ssim_similarity(n: Column, s0: Column, s1: Column, q0: Column, q1: Column, c: Column, ssim_clamp: float = 0.0) -> Column:
    """The variant by signed covariance: a similarity within clamp and 1; 0 where no weight is."""
    v0, v1, cov = _statistics(n, s0, s1, q0, q1, c)
    return F.when(n <= 0, 0.0).otherwise(clamp((2.0 * cov + C2) / (v0 + v1 + C2), ssim_clamp, 1.0))


SUMS = ("n", "s0", "s1", "q0", "q1", "c")


def ssim(pairs: DataFrame, variant: str = "cpu", ssim_clamp: float = 0.0, l0: str = "v0", l1: str = "v1", weight: str | None = None, arranged: bool = False) -> DataFrame:
    """pairs (pair_id, y, x and two lumas) with ssim by pixel."""
    score = ssim_cost if variant == "cpu" else ssim_similarity
    return moments(pairs, keys=("pair_id",), l0=l0, l1=l1, weight=weight, arranged=arranged).withColumn("ssim", score(*map(F.col, SUMS), ssim_clamp=ssim_clamp)).drop(*SUMS)


def total_energy(terms: DataFrame, w_ui: float = 100.0, w_ssim: float = 1.0, w_tps: float = 0.001) -> DataFrame:
    """(pair_id, energy) of terms (pair_id, ui, ssim, tps by pixel): means of the first two, and the sum of the last."""
    return terms.groupBy("pair_id").agg((F.avg(w_ui * F.col("ui") + w_ssim * F.col("ssim")) + w_tps * F.sum("tps")).alias("energy"))


def control_point_terms(pairs: DataFrame, points: DataFrame, height: int, width: int) -> DataFrame:
    """(pair_id, y, x, ui_a, ui_bx, ui_by) where control points pull: weights, and twice their pull on the field vx, vy.

    Each point (normalised lx, ly, rx, ry) reaches the pixels around its midpoint; those outside are left out. pairs has
    pair_id, y, x, vx and vy; points hold for every pair.
    """
    def place(name: str, size: int) -> Column:
        return F.col(name) * float(size) - 0.5

    reach = points.select(
        "idx", ((place("lx", width) + place("rx", width)) / 2).alias("cx"), ((place("ly", height) + place("ry", height)) / 2).alias("cy"),
        ((place("rx", width) - place("lx", width)) / 2).alias("tx"), ((place("ry", height) - place("ly", height)) / 2).alias("ty"),
    )
    for axis in "xy":
        reach = reach.withColumn(axis, F.explode(F.sequence(F.floor(f"c{axis}").cast("int"), F.ceil(f"c{axis}").cast("int"))))
    weighed = reach.withColumn("w", (1.0 - F.abs(F.col("y") - F.col("cy"))) * (1.0 - F.abs(F.col("x") - F.col("cx"))))
    hit = pairs.join(F.broadcast(weighed.select("y", "x", "w", "tx", "ty")), ["y", "x"])  # at most four rows a point
    return hit.groupBy("pair_id", "y", "x").agg(
        F.sum("w").alias("ui_a"), F.sum(2.0 * F.col("w") * (F.col("vx") - F.col("tx"))).alias("ui_bx"), F.sum(2.0 * F.col("w") * (F.col("vy") - F.col("ty"))).alias("ui_by")
    )


def _hits(p: tuple[Column, Column], d: tuple[Column, Column], turned: Column) -> Column:
    """Where the line from p along d meets the eight edges of the ring; null for an edge that it misses."""
    return F.zip_with("ring", turned, lambda a, b: segment_hit(p, d, (a["px"], a["py"]), (b["px"], b["py"])))


def foldover_limit(field: DataFrame, gx: Column, gy: Column, eps: float = 0.01, variant: str = "cpu", arranged: bool = False) -> DataFrame:
    """field (pair_id, y, x, vx, vy) with limit: how far a pixel may go along the direction before it crosses its ring.

    In image 0 the pixel is at q - v and goes along -g, in image 1 at q + v and along g. The smallest hit of both, less
    eps and no less than 0; where nothing is hit 1, and with variant gpu no more than 10.
    """
    wide = field.withColumns({"__gx": gx, "__gy": gy})
    nearest = []
    for sign in (-1, 1):
        wide = one_ring(wide, sign, arranged=arranged)
        arranged = True
        p = (F.col("x") + sign * F.col("vx"), F.col("y") + sign * F.col("vy"))
        d = (sign * F.col("__gx"), sign * F.col("__gy"))
        turned = F.concat(F.slice("ring", 2, len(RING) - 1), F.slice("ring", 1, 1))
        name = f"__near{'l' if sign < 0 else 'r'}"
        wide = wide.withColumn(name, F.array_min(F.filter(_hits(p, d, turned), lambda t: t >= 0))).drop("ring")
        nearest.append(F.col(name))
    nearest = F.least(*nearest)
    limit = F.when(nearest.isNull(), 1.0 if variant == "cpu" else 10.0).otherwise(F.greatest(F.lit(0.0), nearest - eps))
    return wide.withColumn("limit", limit if variant == "cpu" else F.least(limit, F.lit(10.0))).drop("__gx", "__gy", "__nearl", "__nearr")
