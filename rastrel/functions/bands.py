"""Digital filters with mirrored ends as banded matrices, and their inverses by LU factors without pivoting."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Pivots below are taken for none.
LEAST_PIVOT = 1e-6

Taps = tuple[tuple[int, float], ...]


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Indices of a line of n that goes on as its mirror image."""
    i = np.mod(i, 2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def band(taps: Taps, n: int) -> np.ndarray:
    """The filter of a line of n as a matrix: entry (i, j) stands at [i, j - i + reach]."""
    reach = max(abs(k) for k, _ in taps)
    out, i = np.zeros((n, 2 * reach + 1)), np.arange(n)
    for k, w in taps:
        np.add.at(out, (i, mirrored(i + k, n) - i + reach), w)
    return out


def filtered(lines: np.ndarray, taps: Taps) -> np.ndarray:
    """The filter applied to each of the lines (rows)."""
    i = np.arange(lines.shape[1])
    return sum(w * lines[:, mirrored(i + k, lines.shape[1])] for k, w in taps) if lines.shape[1] else lines


@lru_cache(maxsize=64)
def factors(taps: Taps, n: int) -> np.ndarray:
    """Lower and upper factors of band(), in its place; a pivot that is too small raises ValueError."""
    out = band(taps, n)
    reach = out.shape[1] // 2
    for p in range(n):
        if abs(out[p, reach]) < LEAST_PIVOT:
            raise ValueError(f"the filter has no inverse for lines of {n}: pivot {p} is {out[p, reach]:.3g}")
        below = np.arange(p + 1, min(n, p + reach + 1))
        share = out[below, p - below + reach] / out[p, reach]
        out[below, p - below + reach] = share
        for j in range(p + 1, min(n, p + reach + 1)):
            out[below, j - below + reach] -= share * out[p, j - p + reach]
    return out


def inverted(lines: np.ndarray, taps: Taps) -> np.ndarray:
    """What the filter makes the lines (rows) from."""
    n = lines.shape[1]
    if not n or taps == ((0, 1.0),):
        return lines
    lu, out = factors(taps, n), lines.astype(float).copy()
    reach = lu.shape[1] // 2
    for i in range(n):
        for k in range(max(0, i - reach), i):
            out[:, i] -= lu[i, k - i + reach] * out[:, k]
    for i in range(n - 1, -1, -1):
        for k in range(i + 1, min(n, i + reach + 1)):
            out[:, i] -= lu[i, k - i + reach] * out[:, k]
        out[:, i] /= lu[i, reach]
    return out
