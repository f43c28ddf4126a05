"""Operators along one axis: each row or column of an image becomes an array, is worked on, and is laid out again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.functions.bands import inverted
from rastrel.functions.composed import Cardinal, Composed
from rastrel.functions.filters import recursive_weights
from rastrel.functions.kernels import Kernel, kernel
from rastrel.functions.pixels import linear_to_srgb, srgb_to_linear
from rastrel.functions.vectors import extended

KEYS = ("image_id",)
Taps = list[tuple[int, float]]


def along(df: DataFrame, axis: str, work: Callable[[Column], Column], value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, y, x, value) after `work` on the values of each line of the axis, in order; its length may change."""
    other = "y" if axis == "x" else "x"
    lines = df.groupBy(*keys, other).agg(F.array_sort(F.collect_list(F.struct(axis, value))).alias("__l"))
    done = lines.select(*keys, other, work(F.transform("__l", lambda s: s[value])).alias("__l"))
    return done.select(*keys, other, F.posexplode("__l").alias(axis, value)).select(*keys, "y", "x", value)


def both(df: DataFrame, work: Callable[[Column], Column], value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    return along(along(df, "x", work, value, keys), "y", work, value, keys)


def _at(line: Column, i: Column, n: Column, mode: str) -> Column:
    return F.coalesce(F.get(line, extended(i, n, mode)), F.lit(0.0))


def weighted(line: Column, taps: Taps, mode: str, stride: int = 1) -> Column:
    """The sum of w times the value k further, at every stride-th place, by the extension mode."""
    n = F.size(line)

    def at(i: Column) -> Column:
        out = F.lit(0.0)
        for k, w in taps:
            out = out + F.lit(float(w)) * _at(line, i * stride + k, n, mode)
        return out

    return F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((n - 1) / F.lit(stride)).cast("int")), at)


def convolve(df: DataFrame, taps: Taps, stride: int = 1, border: str = "clamp", norm: float = 1.0, value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Separable convolution, rows then columns; norm multiplies each pass."""
    return both(df, lambda line: weighted(line, [(k, w * norm) for k, w in taps], border, stride), value, keys)


def fir(df: DataFrame, taps: Taps, axis: str | None = None, value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A filter with mirrored ends, on one axis or on both. One tap of weight one changes nothing."""
    if taps == [(0, 1.0)]:
        return df
    work = lambda line: weighted(line, taps, "mirror")
    return along(df, axis, work, value, keys) if axis else both(df, work, value, keys)


def by_length(lines: pd.Series, work: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """work on all lines of one length, side by side."""
    out: list = [None] * len(lines)
    size = lines.map(len).to_numpy()
    for n in np.unique(size):
        where = np.flatnonzero(size == n)
        for k, line in zip(where, work(np.stack([np.asarray(lines.iloc[k], float) for k in where]))):
            out[k] = line
    return pd.Series(out)


def _by_cosines(lines: np.ndarray, taps: Taps, eps: float = 1e-9) -> np.ndarray:
    """Solves fir(x) = line with mirrored ends: a symmetric filter is diagonal in the cosine basis, that is in the
    Fourier transform of the line and its mirror image."""
    n = lines.shape[1]
    if not n:
        return lines
    turn = np.arange(n + 1) * (np.pi / n)
    response = sum(w * np.cos(k * turn) for k, w in taps)
    if np.abs(response).min() < eps:
        raise ValueError("the filter has no inverse")
    return np.fft.irfft(np.fft.rfft(np.concatenate([lines, lines[:, ::-1]], axis=1)) / response, 2 * n)[:, :n]


def ifir(df: DataFrame, taps: Taps, axis: str | None = None, value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The inverse of fir(): in the cosine basis for a symmetric filter, by banded factors for others. A filter without an
    inverse (or one that would need pivoting) raises ValueError."""
    if taps == [(0, 1.0)]:
        return df
    symmetric = sorted(taps) == sorted((-k, w) for k, w in taps)
    work = (lambda a: _by_cosines(a, taps)) if symmetric else (lambda a: inverted(a, tuple(taps)))
    solved = F.pandas_udf(lambda s: by_length(s, work), "array<double>")  # type: ignore[call-overload]
    return along(df, axis, solved, value, keys) if axis else both(df, solved, value, keys)


BORDERS = ("zero", "edge", "repeat", "reflect")


def _swept(x: np.ndarray, b: float, a: np.ndarray, state: np.ndarray) -> np.ndarray:
    """y[n] = b x[n] + a1 y[n-1] + ... along each line of x, from the state (y[-1], y[-2], ...) of each."""
    y = np.concatenate([state[:, ::-1], np.zeros_like(x)], axis=1)
    p = len(a)
    for n in range(x.shape[1]):
        now = b * x[:, n]
        for k in range(p):
            now = now + a[k] * y[:, n + p - 1 - k]
        y[:, n + p] = now
    return y[:, p:]


def _states(y: np.ndarray, p: int) -> np.ndarray:
    """The last p values of each line, the last one first."""
    return y[:, : -p - 1 : -1]


def _step(a: np.ndarray) -> np.ndarray:
    """What takes a state to the next where the input is zero."""
    p = len(a)
    return np.vstack([a, np.eye(p)[: p - 1]])


def recursed_lines(lines: np.ndarray, weights: tuple[float, ...], border: str = "zero") -> np.ndarray:
    """y[n] = b x[n] + a1 y[n-1] + ..., forwards and then backwards, along each of the lines (rows of an array).

    The states at the ends are those of lines that go on for ever: with the value at the edge, as repeated, or reflected.
    With zeros, both sweeps start from rest.
    """
    b, a = weights[0], np.array(weights[1:], float)
    p, n = len(a), lines.shape[1]
    rest = np.zeros((len(lines), p))
    if not n:
        return lines
    if border in ("repeat", "reflect"):
        x = np.concatenate([lines, lines[:, ::-1]], axis=1) if border == "reflect" else lines
        x = np.tile(x, (1, -(-p // x.shape[1])))  # a period that holds a whole state
        turn = np.linalg.inv(np.eye(p) - np.linalg.matrix_power(_step(a), x.shape[1]))
        for _ in range(2):  # from the state that comes back after a period
            x = _swept(x, b, a, _states(_swept(x, b, a, rest), p) @ turn.T)[:, ::-1]
        return x[:, :n]
    if border == "zero":
        return _swept(_swept(lines, b, a, rest)[:, ::-1], b, a, rest)[:, ::-1]
    gain = b / (1 - a.sum())
    low, high = lines[:, :1] * gain, lines[:, -1:] * gain  # what the forward sweep settles at
    y = _swept(lines, b, a, np.repeat(low, p, axis=1))
    # beyond the end the forward sweep goes from its state to `high` by steps of the recursion, and the backward state
    # over that is linear in it: m = step m step + b at the first place
    step, first = _step(a), np.zeros((p, p))
    first[0, 0] = b
    m = np.linalg.solve(np.eye(p * p) - np.kron(step, step.T), first.ravel()).reshape(p, p)
    before = np.concatenate([np.repeat(low, p, axis=1), y], axis=1)
    away = (_states(before, p) - high) @ step.T
    return _swept(y[:, ::-1], b, a, away @ m.T + high * gain)[:, ::-1]


def recursed(line: np.ndarray, weights: tuple[float, ...], border: str = "zero") -> np.ndarray:
    """recursed_lines() of one line."""
    return recursed_lines(np.asarray(line, float)[None], weights, border)[0]


def recursive_filter(df: DataFrame, weights: tuple[float, ...], border: str = "zero", value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Causal and anticausal recursion of order one or two along both axes; lines of one length are swept side by side."""
    if border not in BORDERS:
        raise ValueError(f"no border {border}")

    work = F.pandas_udf(lambda s: by_length(s, lambda a: recursed_lines(a, weights, border)), "array<double>")  # type: ignore[call-overload]
    return both(df, work, value, keys)


def gaussian_blur(df: DataFrame, sigma: float, border: str = "edge", value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A recursive Gaussian: a pass of order one, then one of order two."""
    one, two = recursive_weights(sigma)
    return recursive_filter(recursive_filter(df, one, border, value, keys), two, border, value, keys)


def resized(line: Column, m: int, k: Kernel | Cardinal, mode: str = "mirror", normalise: bool | None = None) -> Column:
    """The line at m places: when it shrinks the kernel is stretched and its weights made to sum to one; when it grows
    the kernel interpolates, with that sum only if the kernel asks for it."""
    n = F.size(line)
    ratio = n / F.lit(float(m))
    wide = F.greatest(ratio, F.lit(1.0))
    half = wide * (k.support / 2)

    def at(i: Column) -> Column:
        centre = (i + 0.5) * ratio - 0.5
        reach = F.sequence(F.ceil(centre - half).cast("int"), F.floor(centre + half).cast("int"))
        zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))

        def add(s: Column, j: Column) -> Column:
            w = k.value((j - centre) / wide)
            return F.struct((s["v"] + w * _at(line, j, n, mode)).alias("v"), (s["w"] + w).alias("w"))

        by_sum = lambda s: s["v"] / F.nullif(s["w"], F.lit(0.0))
        if normalise or normalise is None and k.normalize:
            return F.aggregate(reach, zero, add, by_sum)
        return F.aggregate(reach, zero, add, lambda s: F.when(ratio > 1, by_sum(s)).otherwise(s["v"]))

    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), at)


def scale(
    df: DataFrame, height: int, width: int, to_height: int, to_width: int, k: str = "bspline3", filter_taps: Taps | None = None,
    inverse_taps: Taps | None = None, mode: str = "mirror", value: str = "v", keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Resizes along both axes, first along the one that leaves less to do for the other, then filters."""
    pick = kernel(k)
    steps = [("x", to_width), ("y", to_height)] if to_width * height <= to_height * width else [("y", to_height), ("x", to_width)]
    for axis, m in steps:
        df = along(df, axis, lambda line, m=m: resized(line, m, pick, mode), value, keys) if m != (width if axis == "x" else height) else df.select(*keys, "y", "x", value)
    df = fir(df, filter_taps, None, value, keys) if filter_taps else df
    return ifir(df, inverse_taps, None, value, keys) if inverse_taps else df


def reconstructed(
    df: DataFrame, height: int, width: int, to_height: int, to_width: int, k: Composed, fir_taps: Taps | None = None, ifir_taps: Taps | None = None,
    mode: str = "mirror", gamma: bool = False, value: str = "v", keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Resizes along both axes with a kernel that comes with filters, then filters once more.

    An axis that shrinks is averaged by the stretched generator, and the kernel's filters follow; one that does not is
    filtered first, with gamma in the space of the sRGB curve (the values are linear light, 0 to 1), and interpolated.
    The axis comes first that leaves less to do for the other.
    """
    steps = [("y", height, to_height), ("x", width, to_width)]
    for axis, n, m in steps if to_height * width < to_width * height else steps[::-1]:
        shape = lambda line, m=m: resized(line, m, k.generator, mode)
        if m < n:
            df = along(df, axis, shape, value, keys)
            df = ifir(fir(df, list(k.fir), axis, value, keys), list(k.ifir), axis, value, keys)
            continue
        df = df.withColumn(value, linear_to_srgb(F.col(value))) if gamma else df
        df = ifir(fir(df, list(k.fir), axis, value, keys), list(k.ifir), axis, value, keys)
        df = along(df, axis, shape, value, keys)
        df = df.withColumn(value, srgb_to_linear(F.col(value))) if gamma else df
    df = fir(df, fir_taps, None, value, keys) if fir_taps else df
    return ifir(df, ifir_taps, None, value, keys) if ifir_taps else df


#: Values of a line that are swept in one task.
SPAN = 4096


def swept_by_blocks(df: DataFrame, axis: str, weights: tuple[float, ...], border: str = "zero", span: int = SPAN, value: str = "v", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, y, x, value): recursed_lines() along an axis, with each line cut into blocks of `span` that are swept apart.

    A block's sweep from rest gives the state at its end; those of a line are small and meet in one row, where a state
    goes from block to block by a power of the recursion's matrix; each block is then swept again from its own state. The
    same backwards. A reflected line is one with its mirror image behind it that is repeated.
    """
    if border not in BORDERS:
        raise ValueError(f"no border {border}")
    other, b, a = ("y" if axis == "x" else "x"), weights[0], np.array(weights[1:], float)
    p, gain = len(a), b / (1 - a.sum())
    line = [*keys, other]
    cells = df.select(*line, F.col(axis).alias("i"), F.col(value).cast("double").alias("v"))
    sizes = cells.groupBy(*line).agg((F.max("i") + 1).alias("n"))
    cells = cells.join(sizes, line)
    if border == "reflect":
        twin = cells.select(*line, (2 * F.col("n") - 1 - F.col("i")).alias("i"), "v", "n")
        cells = cells.unionByName(twin)
    length = F.col("n") * (2 if border == "reflect" else 1)

    def blocks(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*line, "n", F.expr(f"i div {span}").cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
        return found.select(*line, "n", "block", F.col("c.v").alias("values"))

    step = _step(a)
    powers = {}

    def ends(values: pd.Series) -> pd.Series:
        """The state at a block's end from rest, and the matrix by which a state passes it, in one row."""

        def one(x: np.ndarray) -> np.ndarray:
            n = x.shape[1]
            if n not in powers:
                powers[n] = np.linalg.matrix_power(step, n).ravel()
            state = _states(np.concatenate([np.zeros((len(x), p)), _swept(x, b, a, np.zeros((len(x), p)))], axis=1), p)
            return np.concatenate([state, np.tile(powers[n], (len(x), 1))], axis=1)

        return by_length(values, one)

    def carried(parts: pd.Series, first: pd.Series) -> pd.Series:
        """The state before each block of a line: flat, block by block. first: that before the first one; null where the
        line repeats, and the state has to come back."""
        out = []
        for row, start in zip(parts, first):
            rows = np.stack([np.asarray(r, float) for r in row])
            moves = [(r[:p], r[p:].reshape(p, p)) for r in rows]
            if start is None:
                whole, shift = np.eye(p), np.zeros(p)
                for e, m in moves:
                    whole, shift = m @ whole, m @ shift + e
                state = np.linalg.solve(np.eye(p) - whole, shift)
            else:
                state = np.asarray(start, float)
            told = []
            for e, m in moves:
                told.append(state)
                state = m @ state + e
            out.append(np.concatenate(told))
        return pd.Series(out)

    def applied(values: pd.Series, state: pd.Series) -> pd.Series:
        out: list = [None] * len(values)
        size = values.map(len).to_numpy()
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            lines, states = (np.stack([np.asarray(s.iloc[k], float) for k in at]) for s in (values, state))
            for k, y in zip(at, _swept(lines, b, a, states)):
                out[k] = y
        return pd.Series(out)

    ends_of, carried_on, applied_to = (F.pandas_udf(f, kind) for f, kind in ((ends, "array<double>"), (carried, "array<double>"), (applied, "array<double>")))  # type: ignore[call-overload]

    def sweep(found: DataFrame, first: DataFrame | None) -> DataFrame:
        """(line, n, block, values) after one sweep; first: (line, start), the states before the first blocks."""
        own = found.select(*line, "block", ends_of("values").alias("end"))
        whole = own.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("block", "end"))).alias("parts"))
        whole = whole.join(first, line) if first is not None else whole.withColumn("start", F.lit(None).cast("array<double>"))
        states = whole.select(*line, carried_on(F.col("parts.end"), F.col("start")).alias("states"))
        met = found.join(states, line).withColumn("state", F.slice("states", F.col("block") * p + 1, F.lit(p)))
        return met.select(*line, "n", "block", applied_to("values", "state").alias("values"))

    def turned(found: DataFrame) -> DataFrame:
        """Blocks in the opposite order, cut anew from the other end."""
        flat = found.select(*line, "n", (F.col("block") * span).alias("at"), F.posexplode("values").alias("k", "v"))
        return blocks(flat.select(*line, "n", (length - 1 - F.col("at") - F.col("k")).alias("i"), "v"))

    at_rest = F.array(*(F.lit(0.0) for _ in range(p)))
    forward, backward = None, None
    if border == "zero":
        forward = backward = sizes.select(*line, at_rest.alias("start"))
    elif border == "edge":
        tips = cells.groupBy(*line).agg(F.min_by("v", "i").alias("low"), F.max_by("v", "i").alias("high"))
        tips = tips.select(*line, (F.col("low") * gain).alias("low"), (F.col("high") * gain).alias("high"))
        forward = tips.select(*line, F.array(*(F.col("low") for _ in range(p))).alias("start"))
    first = sweep(blocks(cells), forward)
    if border == "edge":  # see recursed_lines(): beyond the end the forward sweep goes on to `high`
        settle, start = np.zeros((p, p)), []
        settle[0, 0] = b
        m = np.linalg.solve(np.eye(p * p) - np.kron(step, step.T), settle.ravel()).reshape(p, p) @ step
        tail = first.select(*line, "n", (F.col("block") * span).alias("at"), F.posexplode("values").alias("k", "v")).where(F.col("at") + F.col("k") >= F.col("n") - p)
        last = tail.groupBy(*line).agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("at") + F.col("k")).alias("i"), "v")), asc=False), lambda c: c["v"]).alias("last")).join(tips, line)
        away = [F.coalesce(F.get("last", F.lit(k)), F.col("low")) - F.col("high") for k in range(p)]
        for row in m:
            start.append(sum((F.lit(float(w)) * x for w, x in zip(row, away)), F.lit(0.0)) + F.col("high") * gain)
        backward = last.select(*line, F.array(*start).alias("start"))
    done = sweep(turned(first), backward)
    flat = done.select(*line, "n", (F.col("block") * span).alias("at"), F.posexplode("values").alias("k", "v"))
    place = length - 1 - F.col("at") - F.col("k")
    return flat.select(*line, place.cast("int").alias(axis), "v", "n").where(F.col(axis) < F.col("n")).select(*keys, "y", "x", F.col("v").alias(value))
