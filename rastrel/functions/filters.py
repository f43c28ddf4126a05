"""Digital filters: taps around a centre, as (offset, weight). Inverse ones are to be solved for, not applied."""

from __future__ import annotations

import cmath
import math

from rastrel.functions.kernels import Kernel, kernel

# The right half of each symmetric filter, from the centre outwards.
_HALVES: dict[str, tuple[float, ...]] = {
    "delta": (1.0,),
    "fir_blu35": (8.76565, 4.65992, 0.621773, 0.012285, 1.875e-6),
    "ifir_blu35": (7.36952, 4.67858, 1.20608, 0.10541, 0.00196, 0.00001),
    "fir_dalai1": (49 / 40, -11 / 90, 7 / 720),
    "fir_dalai2": (437 / 320, -97 / 480, 37 / 1920),
    "fir_dalai3": (12223 / 7560, -919 / 2520, 311 / 5040, -41 / 7560),
    "ifir_condat0": (13 / 12, -1 / 24),
    "ifir_condat1": (5 / 6, 1 / 12),
    "ifir_condat2": (233 / 320, 67 / 480, -7 / 1920),
    "ifir_condat3": (79 / 120, 31 / 180, -1 / 720),
    "ifir_condat_omoms3": (523 / 840, 79 / 420, 1 / 1680),
    "a_hat": (2 / 3, 1 / 6),
    "a_omoms2": (311 / 600, 17 / 75, 17 / 1200),
    "a_omoms3": (2971 / 6615, 2839 / 11760, 1 / 30, 73 / 105840),
    "a_omoms4": (88139 / 217728, 18463 / 75600, 45817 / 907200, 13567 / 4762800, 557 / 25401600),
    "a_omoms5": (13626317 / 36590400, 7101889 / 29272320, 7181 / 110880, 73273 / 11708928, 1429 / 8781696, 431 / 878169600),
    "a_mitchell_netravali": (92 / 135, 1141 / 6480, -7 / 405, 1 / 2160),
    "a_keys4": (57 / 70, 71 / 560, -1 / 28, 1 / 560),
    "a_crt": (0.423222, 0.241124, 0.0445654, 0.00264125, 0.0000257689, -0.0000237287),
    "a_omoms3_box": (255 / 448, 47 / 224, 5 / 896),
    "a_keys4_box": (161 / 192, 3 / 32, -5 / 384),
    "a_mitchell_netravali_box": (437 / 576, 37 / 288, -1 / 128),
    "a_omoms5_box": (61733 / 126720, 118997 / 506880, 5459 / 253440, 59 / 506880),
    "mccool": (1 / 2, 2 / 9, 1 / 36),
}


def _bspline_at(degree: int, r: float) -> float:
    """A B-spline of any degree at r, by truncated powers."""
    half = (degree + 1) / 2
    return sum((-1) ** k * math.comb(degree + 1, k) * max(0.0, half - k - abs(r)) ** degree for k in range(degree + 2)) / math.factorial(degree)


def _from_spline(degree: int) -> tuple[float, ...]:
    return tuple(_bspline_at(degree, k) for k in range(degree // 2 + 1))


# Autocorrelations of B-splines of degree n are B-splines of degree 2n + 1 at the integers; with a box, of degree n + 1.
_HALVES |= {f"a_bspline{n}": _from_spline(2 * n + 1) for n in (2, 3, 4, 5)} | {f"a_bspline{n}_box": _from_spline(n + 1) for n in (3, 5)}


def taps(name: str) -> list[tuple[int, float]]:
    """(offset, weight) of a named filter."""
    if name not in _HALVES:
        raise ValueError(f"no filter {name}; there are {', '.join(sorted(_HALVES))}")
    half = _HALVES[name]
    return [(k, half[abs(k)]) for k in range(1 - len(half), len(half))]


def sampled(k: Kernel | str) -> list[tuple[int, float]]:
    """A kernel at the integers, without the zeros at its ends."""
    k = kernel(k) if isinstance(k, str) else k
    found = [(i, float(k.at([float(i)])[0])) for i in range(-k.support, k.support + 1)]
    kept = [i for i, w in found if w]
    return [(i, w) for i, w in found if min(kept) <= i <= max(kept)]


# Poles of the recursive Gaussian for sigma 2 (one pair, one real), and the fit of the exponent to sigma.
_POLE_PAIR, _POLE_REAL, _EXPONENT = complex(1.41650, 1.00829), 1.86543, (0.00399341, 0.4715161)


def gaussian_poles(sigma: float) -> tuple[complex, float]:
    """The two poles for sigma, by the power that the fit gives."""
    q = _EXPONENT[0] + _EXPONENT[1] * sigma
    size, angle = cmath.polar(_POLE_PAIR)
    return cmath.rect(size ** (1 / q), angle / q), _POLE_REAL ** (1 / q)


def recursive_weights(sigma: float) -> tuple[tuple[float, float], tuple[float, float, float]]:
    """((b, a1), (b, a1, a2)) of y[n] = b x[n] + a1 y[n-1] (+ a2 y[n-2]): the passes of order one and two."""
    pair, real = gaussian_poles(sigma)
    size = abs(pair) ** 2
    return (1 - 1 / real, 1 / real), ((1 - 2 * pair.real + size) / size, 2 * pair.real / size, -1 / size)


def van_vliet(sigma: float) -> list[tuple[int, float]]:
    """The seven taps whose inverse is the recursive Gaussian: both denominators, forward times backward."""
    import numpy as np

    (b1, a1), (b2, a2, a3) = recursive_weights(sigma)
    line = np.convolve([1, -a1], [1, -a2, -a3])
    both = np.convolve(line, line[::-1]) / (b1 * b2) ** 2
    return [(k - 3, float(w)) for k, w in enumerate(both)]


NAMES = tuple(sorted(_HALVES))
