"""Reconstruction kernels as piecewise polynomials: one table, read as a Column, as SQL text, or in NumPy."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Polynomial = tuple[float, ...]


@dataclass(frozen=True)
class Kernel:
    """pieces: (upper bound of |r|, coefficients by rising power of |r|); at_bound: values on the bounds themselves.

    An odd kernel changes sign with r. centre shifts r; floor and bell are the constants of a Gaussian spot.
    """

    name: str
    support: int
    pieces: tuple[tuple[float, Polynomial], ...]
    odd: bool = False
    primal: bool = False
    normalize: bool = False
    centre: float = 0.0
    at_bound: tuple[tuple[float, float], ...] = ()
    spot: tuple[float, float, float] | None = field(default=None)

    def value(self, r: Column) -> Column:
        """The kernel at r; zero outside its support."""
        if self.spot:
            base, scale, rate = self.spot
            return F.lit(base) + F.lit(scale) * F.exp(F.lit(rate) * r * r)
        a = F.abs(r - self.centre) if self.centre else F.abs(r)
        out = F.lit(0.0)
        for bound, c in reversed(self.pieces):
            out = F.when(a < bound, _horner(a, c, F.lit)).otherwise(out)
        for bound, v in self.at_bound:
            out = F.when(a == bound, F.lit(v)).otherwise(out)
        return F.when(r < 0, -out).otherwise(out) if self.odd else out

    def sql(self, r: str) -> str:
        """The same as a SQL expression of the text r."""
        if self.spot:
            base, scale, rate = self.spot
            return f"({base!r}::DOUBLE + {scale!r}::DOUBLE * exp({rate!r}::DOUBLE * ({r}) * ({r})))"
        a = f"abs(({r}) - ({self.centre!r}::DOUBLE))" if self.centre else f"abs({r})"
        cases = "".join(f" WHEN {a} = {b!r}::DOUBLE THEN {v!r}::DOUBLE" for b, v in self.at_bound)
        for bound, c in self.pieces:
            text = f"{c[-1]!r}::DOUBLE"
            for x in reversed(c[:-1]):
                text = f"({x!r}::DOUBLE + {a} * {text})"
            cases += f" WHEN {a} < {bound!r}::DOUBLE THEN {text}"
        out = f"(CASE{cases} ELSE 0::DOUBLE END)"
        return f"(CASE WHEN ({r}) < 0 THEN -1 ELSE 1 END * {out})" if self.odd else out

    def at(self, r: np.ndarray) -> np.ndarray:
        r = np.asarray(r, float)
        if self.spot:
            base, scale, rate = self.spot
            return base + scale * np.exp(rate * r * r)
        a, out, done = np.abs(r - self.centre), np.zeros(r.shape), np.zeros(r.shape, bool)
        for bound, v in self.at_bound:
            hit = a == bound
            out[hit], done = v, done | hit
        for bound, c in self.pieces:
            hit = (a < bound) & ~done
            out[hit] = np.polynomial.polynomial.polyval(a[hit], c)
            done |= hit
        return np.where(r < 0, -out, out) if self.odd else out


def _horner(x, c: Polynomial, lit):
    out = lit(c[-1])
    for k in reversed(c[:-1]):
        out = lit(k) + x * out
    return out


def _bspline_pieces(n: int) -> list[tuple[Fraction, list[Fraction]]]:
    """B-spline of degree n by truncated powers: sum of (-1)^k C(n+1, k) (h - k - |r|)^n_+ / n!, h = (n+1)/2."""
    half = Fraction(n + 1, 2)
    bounds = [half - k for k in range(n + 1) if half - k > 0][::-1]
    pieces = []
    for bound in bounds:
        c = [Fraction(0)] * (n + 1)
        for k in range(n + 2):
            edge = half - k
            if edge >= bound:  # still positive on this piece
                for p in range(n + 1):
                    c[p] += Fraction((-1) ** k * math.comb(n + 1, k) * math.comb(n, p) * (-1) ** p, math.factorial(n)) * edge ** (n - p)
        pieces.append((bound, c))
    return pieces


def _bspline(n: int, derivative: int = 0) -> Kernel:
    pieces = _bspline_pieces(n)
    for _ in range(derivative):
        pieces = [(b, [p * c[p] for p in range(1, len(c))]) for b, c in pieces]
    name = "d" * derivative + ("-" if derivative else "") + f"bspline{n}"
    return Kernel(name, n + 1, tuple((float(b), tuple(map(float, c))) for b, c in pieces), odd=derivative == 1, primal=n % 2 == 0)


def _table(name: str, denominator: float, *pieces: tuple[float, tuple[float, ...]], primal: bool = False, at_bound=(), centre: float = 0.0) -> Kernel:
    made = tuple((float(b), tuple(x / denominator for x in c)) for b, c in pieces)
    support = math.ceil(2 * made[-1][0]) if not centre else 3
    return Kernel(name, support, made, primal=primal, at_bound=tuple((b, v / denominator) for b, v in at_bound), centre=centre)


# Bounds and coefficients of the published kernels, by rising power of |r|, over a common denominator.
_PUBLISHED = (
    _table("box", 1, (0.5, (1,)), primal=True, at_bound=((0.5, 0.5),)),
    _table("hat", 1, (1, (1, -1))),
    _table("schaum2", 2, (0.5, (2, 0, -2)), (1.5, (2, -3, 1)), primal=True),
    _table("schaum3", 6, (1, (6, -3, -6, 3)), (2, (6, -11, 6, -1))),
    _table("schaum4", 24, (0.5, (24, 0, -30, 0, 6)), (1.5, (24, -20, -20, 20, -4)), (2.5, (24, -50, 35, -10, 1)), primal=True),
    _table("schaum5", 120, (1, (120, -40, -150, 50, 30, -10)), (2, (120, -130, -75, 125, -45, 5)), (3, (120, -274, 225, -85, 15, -1))),
    _table("mitchell_netravali", 18, (1, (16, 0, -36, 21)), (2, (32, -60, 36, -7))),
    _table("keys4", 2, (1, (2, 0, -5, 3)), (2, (4, -8, 5, -1))),
    _table("keys6", 12, (1, (12, 0, -28, 16)), (2, (30, -59, 36, -7)), (3, (-18, 21, -8, 1))),
    _table("parabolic", 4, (1, (3, 0, -3))),
    _table("dogson_interpolation", 2, (0.5, (2, 0, -4)), (1.5, (3, -5, 2)), primal=True),
    _table("dogson_approximation", 8, (0.5, (6, 0, -8)), (1.5, (9, -12, 4)), primal=True),
    _table("meijering5", 64, (1, (64, 0, -136, 0, 126, -54)), (2, (122, -165, -56, 170, -84, 13)), (3, (-486, 891, -648, 234, -42, 3))),
    _table(
        "meijering7", 83232,
        (1, (83232, 0, -173328, 0, 134200, 0, -66117, 22013)), (2, (6216, 438956, -1189728, 1193220, -558240, 114996, -4293, -1127)),
        (3, (2744520, -7935956, 9558912, -6252540, 2408920, -548436, 68493, -3627)), (4, (872448, -1599488, 1254144, -545280, 142000, -22152, 1917, -71)),
    ),
    _table("german", 144, (1, (144, 0, -335, 185, 6)), (2, (312, -580, 306, -29, -9)), (3, (-48, 4, 40, -21, 3)), (4, (-48, 40, -11, 1))),
    _table("linrev", 1, (1, (1, -1)), primal=True, centre=0.5 * (1 - math.sqrt(3) / 3)),
    _table("omoms2", 120, (0.5, (86, 0, -120)), (1.5, (137, -180, 60)), primal=True, at_bound=((0.5, 58),)),
    _table("omoms3", 42, (1, (26, 3, -42, 21)), (2, (58, -85, 42, -7))),
    _table(
        "omoms4", 120960, (0.5, (68298, 0, -65520, 0, 30240)), (1.5, (60868, 42000, -157920, 100800, -20160)), (2.5, (207383, -323400, 190680, -50400, 5040)),
        primal=True, at_bound=((0.5, 53776), (1.5, 6696)),
    ),
    _table("omoms5", 7920, (1, (4122, -10, -3240, -400, 1980, -660)), (2, (2517, 6755, -14940, 10100, -2970, 330)), (3, (17121, -27811, 18180, -5980, 990, -66))),
    _table("somoms4", 1920, (0.5, (1090, 0, -1056, 0, 480)), (1.5, (980, 640, -2496, 1600, -320)), (2.5, (3275, -5120, 3024, -800, 80)), primal=True),
    _table("somoms5", 11880, (1, (6474, 0, -5760, -100, 2970, -990)), (2, (4839, 7875, -21060, 14900, -4455, 495)), (3, (24327, -40365, 26820, -8920, 1485, -99))),
    Kernel("crt", 6, (), primal=True, normalize=True, spot=(-0.000023979224, 0.59850358, -1.125)),
)

KERNELS: dict[str, Kernel] = {k.name: k for k in (*_PUBLISHED, *(_bspline(n) for n in (2, 3, 4, 5, 7)), *(_bspline(n, d) for d in (1, 2) for n in (3, 5, 7)))}


def kernel(name: str) -> Kernel:
    """A kernel by name; d- and dd- name first and second derivatives of the odd-degree B-splines."""
    if name not in KERNELS:
        raise ValueError(f"no kernel {name}; there are {', '.join(sorted(KERNELS))}")
    return KERNELS[name]
