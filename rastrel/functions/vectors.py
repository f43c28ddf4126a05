"""Scalar and small-vector functions. A vector is a tuple of Columns; functions of one take any number of components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def saturate(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(t: Column, low: float, high: float) -> Column:
    """0 below low, 1 above high, 3u^2 - 2u^3 between."""
    u = saturate((t - low) / (high - low))
    return u * u * (3.0 - 2.0 * u)


def fract(c: Column) -> Column:
    return c - F.floor(c)


def rsqrt(c: Column) -> Column:
    """Null for zero."""
    return 1.0 / F.nullif(F.sqrt(c), F.lit(0.0))


def square(c: Column) -> Column:
    return c * c


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def subtract(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def multiply(a: Vector, k: Column | float) -> Vector:
    return tuple(x * k for x in a)


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vector) -> Vector:
    """Null components for a vector of length zero."""
    n = F.nullif(length(a), F.lit(0.0))
    return tuple(x / n for x in a)


def reflect(incident: Vector, normal: Vector) -> Vector:
    twice = 2.0 * dot(incident, normal)
    return tuple(i - n * twice for i, n in zip(incident, normal, strict=True))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def catmull_rom(t: Column, b: float = 0.0, c: float = 0.5) -> Column:
    """The cubic of Mitchell and Netravali at |t|, as an interpolating spline by default."""
    a = F.abs(t)
    near = ((12 - 9 * b - 6 * c) * a * a * a + (-18 + 12 * b + 6 * c) * a * a + (6 - 2 * b)) / 6.0
    far = ((-b - 6 * c) * a * a * a + (6 * b + 30 * c) * a * a + (-12 * b - 48 * c) * a + (8 * b + 24 * c)) / 6.0
    return F.when(a < 1, near).when(a < 2, far).otherwise(0.0)


def segment_hit(p: Vector, d: Vector, a: Vector, b: Vector) -> Column:
    """The t of the point p + t d on the segment from a to b; null if they are parallel or meet outside it."""
    ex, ey = b[0] - a[0], b[1] - a[1]
    det = F.nullif(d[0] * ey - d[1] * ex, F.lit(0.0))
    wx, wy = a[0] - p[0], a[1] - p[1]
    t, s = (wx * ey - wy * ex) / det, (wx * d[1] - wy * d[0]) / det
    return F.when(s.between(0.0, 1.0), t)


def extended(i: Column, n: Column, mode: str) -> Column:
    """An index brought into 0..n-1: clamp, repeat or mirror (its own edge repeated); none gives null outside."""
    if mode == "clamp":
        return F.least(F.greatest(i, F.lit(0)), n - 1)
    if mode == "repeat":
        return F.pmod(i, n)
    if mode == "mirror":
        k = F.pmod(i, 2 * n)
        return F.when(k < n, k).otherwise(2 * n - 1 - k)
    if mode == "none":
        return F.when((i >= 0) & (i < n), i)
    raise ValueError(f"no extension {mode}")
