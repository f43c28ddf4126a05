"""Pixel functions: each takes and gives Columns, so that Catalyst compiles them with the plan around them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastrel.functions.vectors import clamp, saturate

RGB = tuple[Column, Column, Column]


def to_float(c: Column) -> Column:
    """Bytes to 0..1."""
    return c.cast("double") / 255.0


def to_byte(c: Column, rescale: bool = True) -> Column:
    """0..1 to bytes, rounded; without rescale the value is cut off."""
    return F.floor(saturate(c) * 255.0 + 0.5).cast("short") if rescale else c.cast("short")


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 weights, for linear light."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def luminance(r: Column, g: Column | None = None, b: Column | None = None) -> Column:
    """Rec. 601 weights; a single channel is its own luminance."""
    return r if g is None or b is None else 0.299 * r + 0.587 * g + 0.114 * b


def srgb_to_linear(c: Column, fast: bool = False) -> Column:
    """The sRGB curve undone; fast takes a square in place of the power 2.4."""
    t = (c + 0.055) / 1.055
    return F.when(c <= 0.04045, c / 12.92).otherwise(t * t if fast else F.pow(t, F.lit(2.4)))


def linear_to_srgb(c: Column, fast: bool = False) -> Column:
    root = F.sqrt(F.greatest(c, F.lit(0.0))) if fast else F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4))
    return F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * root - 0.055)


# Linear RGB to XYZ and back with the D65 white, and RGB to YIQ and back.
_XYZ = ((0.412424, 0.357579, 0.180464), (0.212656, 0.715158, 0.0721856), (0.0193324, 0.119193, 0.950444))
_FROM_XYZ = ((3.24071, -1.53726, -0.498571), (-0.969258, 1.87599, 0.0415557), (0.0556352, -0.203996, 1.05707))
_WHITE = (0.95047, 1.0, 1.08883)
_YIQ = ((0.299, 0.587, 0.114), (0.595, -0.274453, -0.321263), (0.211456, -0.522591, 0.311135))
_RGB = ((1.0, 0.9563, 0.6210), (1.0, -0.2721, -0.6474), (1.0, -1.1070, 1.7046))


def _times(matrix: tuple, v: RGB) -> RGB:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in matrix)  # type: ignore[return-value]


def rgb_to_lab(r: Column, g: Column, b: Column) -> RGB:
    """CIE Lab of linear RGB: cube roots with a linear toe."""
    fx, fy, fz = (F.when(t > 0.008856, F.cbrt(t)).otherwise((903.3 * t + 16.0) / 116.0) for t in (c / w for c, w in zip(_times(_XYZ, (r, g, b)), _WHITE)))
    return 116.0 * fy - 16.0, 500.0 * (fx - fy), 200.0 * (fy - fz)


def lab_to_rgb(light: Column, a: Column, b: Column) -> RGB:
    """Linear RGB of CIE Lab."""
    fy = (light + 16.0) / 116.0
    xyz = (F.when(t * t * t > 0.008856, t * t * t).otherwise((t - 16 / 116) / 7.787) for t in (fy + a / 500.0, fy, fy - b / 200.0))
    return _times(_FROM_XYZ, tuple(c * w for c, w in zip(xyz, _WHITE)))  # type: ignore[arg-type]


def rgb_to_yiq(r: Column, g: Column, b: Column) -> RGB:
    return _times(_YIQ, (r, g, b))


def yiq_to_rgb(y: Column, i: Column, q: Column) -> RGB:
    return _times(_RGB, (y, i, q))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> RGB:
    """Hue in degrees, saturation and lightness; a gray has hue and saturation 0."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    chroma, light = high - low, (high + low) / 2
    safe = F.nullif(chroma, F.lit(0.0))
    turn = F.when(high == r, (g - b) / safe + F.when(g < b, 6.0).otherwise(0.0)).when(high == g, (b - r) / safe + 2.0).otherwise((r - g) / safe + 4.0)
    spread = F.nullif(1.0 - F.abs(2.0 * light - 1.0), F.lit(0.0))
    return F.coalesce(60.0 * turn, F.lit(0.0)), F.coalesce(chroma / spread, F.lit(0.0)), light


def hsl_to_rgb(h: Column, s: Column, light: Column) -> RGB:
    chroma = (1.0 - F.abs(2.0 * light - 1.0)) * s

    def channel(shift: float) -> Column:
        """Between light - chroma/2 and light + chroma/2, by how near the hue is to the channel's own."""
        k = F.pmod(h / 60.0 + shift, F.lit(6.0))
        return light + chroma * (clamp(F.abs(k - 3.0) - 1.0, 0.0, 1.0) - 0.5)

    return channel(0.0), channel(4.0), channel(2.0)


def adjust_hsl(r: Column, g: Column, b: Column, hue: float, saturation: float, lightness: float) -> RGB:
    """Hue turned by degrees; saturation and lightness by percent, lightness towards white or black by half as much.

    A gray has no hue to turn and stays gray.
    """
    h, s, light = rgb_to_hsl(r, g, b)
    share = lightness / 200
    lit = saturate(light * (1 + share) if share < 0 else light + (1.0 - light) * share)
    return hsl_to_rgb(F.pmod(h + hue, F.lit(360.0)), saturate(s * (1 + saturation / 100)), lit)


def posterize(c: Column, levels: int) -> Column:
    return saturate(F.rint(c * (levels - 1.0)) / (levels - 1.0))


def threshold(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), 1.0).otherwise(0.0)


def scale(c: Column, a: float) -> Column:
    return c * a


def bias(c: Column, a: float) -> Column:
    return c + a


def replacement(rgb: RGB, old: tuple[float, ...], new: tuple[float, ...], tau: tuple[float, ...]) -> RGB:
    """Where every channel is within tau of old: new plus the distance, kept in 0..1."""
    near = F.lit(True)
    for c, o, t in zip(rgb, old, tau):
        near &= F.abs(c - o) <= t
    return tuple(F.when(near, saturate(n + F.abs(c - o))).otherwise(c) for c, o, n in zip(rgb, old, new))  # type: ignore[return-value]


def polynomial(c: Column, coefficients: list[float]) -> Column:
    """Coefficients by rising power."""
    out = F.lit(float(coefficients[-1]))
    for k in reversed(coefficients[:-1]):
        out = F.lit(float(k)) + c * out
    return saturate(out)


def root(c: Column, n: float) -> Column:
    return F.when(c < 0, 0.0).otherwise(saturate(F.pow(F.greatest(c, F.lit(0.0)), F.lit(1.0 / n))))


def gradient_edge(dx: Column, dy: Column) -> Column:
    return saturate(F.sqrt(dx * dx + dy * dy))


def laplacian(dxx: Column, dyy: Column) -> Column:
    return saturate(dxx + dyy)


def laplace_enhancement(c: Column, dxx: Column, dyy: Column, multiple: float) -> Column:
    return saturate(c - multiple * (dxx + dyy))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, within 1.5e-7."""
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def yaroslavsky(c: Column, dx: Column, dy: Column, dxx: Column, dxy: Column, dyy: Column, rho: float, h: float) -> Column:
    """The bilateral filter's closed form: diffusion along the gradient and across it, with weights that tend to 1/6.

    With t = |gradient| rho / h: across, g = t exp(-t^2) / (3 sqrt(pi) erf(t)); along, f = 3 g + (3 g - 1/2) / t^2.
    Without a gradient no direction stands out, and the Laplacian takes 1/6.
    """
    norm2 = dx * dx + dy * dy
    safe = F.nullif(norm2, F.lit(0.0))
    along = (dx * dx * dxx + 2.0 * dx * dy * dxy + dy * dy * dyy) / safe
    across = (dy * dy * dxx - 2.0 * dx * dy * dxy + dx * dx * dyy) / safe
    t = F.sqrt(norm2) * rho / h
    flat = t < 1e-6
    u = F.when(flat, 1.0).otherwise(t)
    g = F.when(flat, 1 / 6).otherwise(u * F.exp(-u * u) / (3.0 * 1.77245385 * erf(u)))
    f = F.when(flat, 1 / 6).otherwise(3.0 * g + (3.0 * g - 0.5) / (u * u))
    return saturate(c + rho * rho * F.coalesce(f * along + g * across, (dxx + dyy) / 6.0))


def brightness_contrast(c: Column, brightness: float, contrast: float) -> Column:
    """Brightness moves towards white or black; contrast is the slope around the middle, as the tangent of an angle."""
    slant = math.tan((contrast + 1) * math.pi / 4)
    moved = c * (1 + brightness) if brightness < 0 else c + (1.0 - c) * brightness
    return saturate((moved - 0.5) * slant + 0.5)


def unsharp(r: Column, g: Column, b: Column, blurred_y: Column, amount: float, limit: float) -> RGB:
    """Luma grown in proportion to its difference from a blurred one; differences below the limit count by their square."""
    y, i, q = rgb_to_yiq(r, g, b)
    d = y - blurred_y
    return yiq_to_rgb(y + y * amount * F.when(d < limit, d * d).otherwise(d), i, q)
