"""The coarse-to-fine matcher: halfway fields between pairs of images, layer by layer.

A job is a layer of a pair, with its own parameters, points and masks. Jobs of one size go side by side. Pixels are
visited by 25 colours, (y mod 5, x mod 5). Those of one colour are five apart, so what they read and write does not
overlap, and NumPy moves all of them at once; the colours follow each other. Only pixels near one that moved are looked
at, and only the squares around those that move are summed anew.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rastrel.functions.filters import sampled
from rastrel.functions.kernels import kernel
from rastrel.operators.energy import C2
from rastrel.operators.neighbourhood import RING, thin_plate_stencils
from rastrel.operators.resample import level_sizes
from rastrel.operators.solvers import coarse_field, locked_mask, point_terms

GOLDEN = 0.618033989
#: Trial moves that are looked at together: their squares stay in a core's cache.
BLOCK = 2048


@dataclass(frozen=True)
class Settings:
    """Weights and schedule; boundary is none, corner or border."""

    w_ssim: float = 1.0
    w_tps: float = 0.001
    w_ui: float = 100.0
    ssim_clamp: float = 0.0
    max_iter: int = 2000
    drop: float = 2.0
    eps: float = 0.01
    start_res: int = 8
    boundary: str = "none"
    points: tuple[tuple[float, float, float, float], ...] = ()


def bilinear(images: np.ndarray, b: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Images (by b) at places, the nearest pixel beyond their borders."""
    high, wide = images.shape[1:]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    ya, yb, xa, xb = (np.clip(a, 0, n - 1) for a, n in ((y0, high), (y0 + 1, high), (x0, wide), (x0 + 1, wide)))
    return (1 - fy) * ((1 - fx) * images[b, ya, xa] + fx * images[b, ya, xb]) + fy * ((1 - fx) * images[b, yb, xa] + fx * images[b, yb, xb])


#: What a mask is outside of its image: ignored.
OUTSIDE = 255.0


class Masked:
    """Images and their masks, to be looked up together: framed by two pixels, of the image's border and of OUTSIDE. Each
    pixel has a row of its own, its right, its lower and its lower right neighbour's value and mask, so a place is one row."""

    def __init__(self, images: np.ndarray, masks: np.ndarray | None):
        frame = ((0, 0), (2, 2), (2, 2))
        masks = np.zeros(images.shape) if masks is None else masks
        both = np.stack([np.pad(images, frame, mode="edge"), np.pad(masks.astype(float), frame, constant_values=OUTSIDE)], -1)
        self.high, self.wide = images.shape[1:]
        corners = [both[:, dy : dy + self.high + 3, dx : dx + self.wide + 3] for dy in (0, 1) for dx in (0, 1)]
        self.rows = np.stack(corners, -2).reshape(-1, 2, 2, 2)  # lines, columns, value and mask

    def at(self, b: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(2, ...): values and masks at places, bilinear."""
        y0, x0 = np.floor(y), np.floor(x)
        fy, fx = (y - y0)[..., None], (x - x0)[..., None, None]
        line = b * (self.high + 3) + (np.minimum(np.maximum(y0, -2), self.high) + 2).astype(int)
        found = self.rows.take(line * (self.wide + 3) + (np.minimum(np.maximum(x0, -2), self.wide) + 2).astype(int), axis=0)
        left = found[..., 0, :]
        lines = left + fx * (found[..., 1, :] - left)
        return np.moveaxis((1 - fy) * lines[..., 0, :] + fy * lines[..., 1, :], -1, 0)


def resize_matrix(n: int, m: int, name: str = "bspline3", mirror: bool = True, cardinal: bool = True) -> np.ndarray:
    """(m, n): resizing a line, as lines.resized and the inverse filter do it."""
    k, ratio = kernel(name), n / m
    wide, out = max(ratio, 1.0), np.zeros((m, n))
    for i in range(m):
        c = (i + 0.5) * ratio - 0.5
        reach = np.arange(int(np.ceil(c - wide * k.support / 2)), int(np.floor(c + wide * k.support / 2)) + 1)
        w = k.at((reach - c) / wide)
        at = np.mod(reach, 2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at) if mirror else np.clip(reach, 0, n - 1)
        np.add.at(out[i], at, w / w.sum() if ratio > 1 else w)
    if cardinal:
        fir = np.zeros((m, m))
        for i in range(m):
            for d, w in sampled(name):
                j = (i + d) % (2 * m)
                fir[i, j if j < m else 2 * m - 1 - j] += w
        out = np.linalg.solve(fir, out)
    return out


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    p = np.pad(a, ((0, 0), (2, 2), (2, 2)))
    return p[:, 2 + dy : 2 + dy + a.shape[1], 2 + dx : 2 + dx + a.shape[2]]


def _box(a: np.ndarray) -> np.ndarray:
    h, w = a.shape[1:]
    p = np.pad(a, ((0, 0), (2, 2), (2, 2)))
    rows = sum(p[:, :, k : k + w] for k in range(5))
    return sum(rows[:, k : k + h] for k in range(5))


def _ssim(n, s0, s1, q0, q1, c, clamp) -> np.ndarray:
    """The cost of squares by their six sums. As C3 is half of C2, the deviations cancel out of contrast times structure,
    and with all terms times n^2 one division is left. Arrays are used again, as this is where the matcher's time goes."""
    other = np.maximum(n, 1.0)
    other *= other
    other *= C2
    var, more, t = n * q0, n * q1, s0 * s0
    var -= t
    np.maximum(var, 0, out=var)
    more -= np.multiply(s1, s1, out=t)
    np.maximum(more, 0, out=more)
    var += more
    var += other
    cov = np.multiply(n, c, out=more)
    cov -= np.multiply(s0, s1, out=t)
    np.abs(cov, out=cov)
    cov *= 2
    cov += other
    cov /= var
    cost = np.subtract(1, cov, out=cov)
    np.maximum(cost, 0, out=cost)
    np.minimum(cost, 1 - clamp, out=cost)
    cost *= n > 1
    return cost


@dataclass(frozen=True)
class Window:
    """Where a region of images of height by width lies: its first pixel; where its parts of the two images begin; and
    the pixels that may move, as rows and columns of the region."""

    height: int
    width: int
    y: int
    x: int
    first: tuple[int, int]
    second: tuple[int, int]
    rows: tuple[int, int]
    columns: tuple[int, int]
    reach: float


class Level:
    """The state of one level of jobs of one size, side by side: fields (b, y, x, 2), lumas, weights by both masks, their
    sums over squares, and the quadratic terms of each pixel.

    Masks are 0 to 255, what is 255 is ignored; each is looked up where its image is, so weights move with the field.
    A window makes it a region of larger images (with two pixels more than those that squares of movable ones reach).
    """

    def __init__(self, i0: np.ndarray, i1: np.ndarray, field: np.ndarray, settings: Settings | Sequence[Settings], masks: tuple[np.ndarray, np.ndarray] | None = None, window: Window | None = None):
        self.i0, self.i1, self.v = i0, i1, field.copy()
        self.n, self.h, self.w = field.shape[:3]
        own = [settings] * self.n if isinstance(settings, Settings) else list(settings)
        self.w_ssim, self.w_tps, self.w_ui, self.clamp, self.eps = (np.array([getattr(s, c) for s in own], float) for c in ("w_ssim", "w_tps", "w_ui", "ssim_clamp", "eps"))
        self.at = window or Window(self.h, self.w, 0, 0, (0, 0), (0, 0), (0, self.h), (0, self.w), np.inf)
        high, wide = self.at.height, self.at.width
        rows, columns = np.arange(self.h) + self.at.y, np.arange(self.w) + self.at.x
        self.seen = [Masked(i, m) for i, m in zip((i0, i1), masks or (None, None))]
        part = np.ix_(rows, columns)
        self.locked = np.stack([locked_mask(high, wide, s.boundary)[part] for s in own])
        stencils = thin_plate_stencils()
        border = lambda i, n: np.select([i == 0, i == 1, i == n - 1, i == n - 2], [0, 1, 4, 3], 2)
        self.stencil = stencils[border(rows, high)[:, None], border(columns, wide)[None, :]]
        self.tps_a = self.stencil[..., 2, 2] / 2
        self.ui_a, self.ui_target = np.zeros((self.n, self.h, self.w)), np.zeros((self.n, self.h, self.w, 2))
        for k, s in enumerate(own):
            for y, x, w, tx, ty in point_terms(list(s.points), high, wide):
                y, x = y - self.at.y, x - self.at.x
                if 0 <= y < self.h and 0 <= x < self.w:
                    self.ui_a[k, y, x] += w
                    self.ui_target[k, y, x] += w * np.array([tx, ty])
        self.improving = np.ones((self.n, self.h, self.w), bool)
        b, y, x = np.mgrid[: self.n, : self.h, : self.w]
        self.luma0, self.luma1, self.mask = self._looked_up(b, y, x, self.v)
        m, p, q = self.mask, self.luma0, self.luma1
        self.sums = np.stack([_box(t) for t in (m, m * p, m * q, m * p * p, m * q * q, m * p * q)])
        self.cost = _ssim(*self.sums, self.clamp[:, None, None])

    def _looked_up(self, b, y, x, v) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both lumas and the weight of pixels of the region that are displaced by v."""
        out = []
        for seen, sign, (top, left) in zip(self.seen, (-1, 1), (self.at.first, self.at.second)):
            out.append(seen.at(b, y + (self.at.y - top) + sign * v[..., 1], x + (self.at.x - left) + sign * v[..., 0]))
        return out[0][0], out[1][0], (1 - out[0][1] / OUTSIDE) * (1 - out[1][1] / OUTSIDE)

    def energies(self) -> np.ndarray:
        """The whole energy of each job: similarity and control points by the area, and the bending."""
        bent = np.zeros(self.v.shape)
        for c in range(2):
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    bent[..., c] += self.stencil[..., dy + 2, dx + 2] * _shifted(self.v[..., c], dy, dx)
        ui = (self.ui_a * (self.v**2).sum(-1) - 2 * (self.ui_target * self.v).sum(-1)).sum((1, 2))
        return (self.w_ssim * self.cost.sum((1, 2)) + self.w_ui * ui) / (self.at.height * self.at.width) + self.w_tps * 0.5 * (bent * self.v).sum((1, 2, 3))

    @staticmethod
    def _terms(p, q, m) -> np.ndarray:
        """What pixels add to the six sums."""
        out = np.empty((6, *m.shape))
        out[0], out[1], out[2] = m, m * p, m * q
        out[3], out[4], out[5] = out[1] * p, out[2] * q, out[1] * q
        return out

    def _moved(self, b, y, x, d, old: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """What is added to the six sums of the squares around pixels that move by d; and their new lumas and weights."""
        new = self._looked_up(b, y, x, self.v[b, y, x] + d)
        delta = self._terms(*new)
        delta -= self._terms(self.luma0[b, y, x], self.luma1[b, y, x], self.mask[b, y, x]) if old is None else old
        return delta, new

    def _change(self, b, y, x, d, tps_b, squares, inside, cells, old: np.ndarray | None = None) -> np.ndarray:
        """The change of energy if the pixels (b, y, x) move by d; old: what they add to the sums now."""
        delta, _ = self._moved(b, y, x, d, old)
        new = _ssim(*(squares + delta[:, :, None]), self.clamp[b][:, None])
        new -= cells
        ssim = np.einsum("ij,ij->i", new, inside.astype(float))
        a = self.ui_a[b, y, x]
        ui_b = 2 * (a[:, None] * self.v[b, y, x] - self.ui_target[b, y, x])
        d2 = (d * d).sum(-1)
        ui = a * d2 + (ui_b * d).sum(-1)
        tps = self.tps_a[y, x] * d2 + (tps_b * d).sum(-1)
        return (self.w_ui[b] * ui + self.w_ssim[b] * ssim) / (self.at.height * self.at.width) + self.w_tps[b] * tps

    def _inside(self, y, x) -> np.ndarray:
        return (y >= 0) & (y < self.h) & (x >= 0) & (x < self.w)

    def _limit(self, b, y, x, g) -> np.ndarray:
        """How far pixels may go along g before they cross the ring of their neighbours, in either image."""
        own = self.v[b, y, x]
        dy, dx = np.array(RING).T[:, :, None]
        ny, nx = y + dy, x + dx
        around = np.where(self._inside(ny, nx)[..., None], self.v[b, np.clip(ny, 0, self.h - 1), np.clip(nx, 0, self.w - 1)], own)
        sign = np.array([-1.0, 1.0])[:, None, None, None]  # images, corners of the ring, pixels, axes
        ring = np.stack([nx, ny], -1) + sign * around
        p, d = np.stack([x, y], -1) + sign * own, sign * g
        e, w = np.roll(ring, -1, 1) - ring, ring - p
        det = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (w[..., 0] * e[..., 1] - w[..., 1] * e[..., 0]) / det, (w[..., 0] * d[..., 1] - w[..., 1] * d[..., 0]) / det
        best = np.where((det != 0) & (u >= 0) & (u <= 1) & (t >= 0), t, np.inf).min((0, 1))
        return np.minimum(np.where(np.isinf(best), 1.0, np.maximum(0.0, best - self.eps[b])), self.at.reach)

    def _candidates(self, cy: int, cx: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pixels of a colour that have one that improves in their square: each such is in the square of one of them."""
        b, y, x = np.nonzero(self.improving)
        y, x = (c - 2 + (want - first - (c - 2)) % 5 for c, want, first in ((y, cy, self.at.y), (x, cx, self.at.x)))
        (top, bottom), (left, right) = self.at.rows, self.at.columns
        there = (y >= top) & (y < bottom) & (x >= left) & (x < right)
        flat = np.unique((b[there] * self.h + y[there]) * self.w + x[there])
        return np.unravel_index(flat, self.improving.shape)

    def _colour(self, cy: int, cx: int, moved: np.ndarray) -> None:
        """Moves the pixels of a colour; sets `moved` of the jobs in which one does."""
        b, y, x = self._candidates(cy, cx)
        self.improving[b, y, x] = False
        free = ~self.locked[b, y, x]
        b, y, x = b[free], y[free], x[free]
        if not len(y):
            return
        dy, dx = (a.ravel() for a in np.mgrid[-2:3, -2:3])
        ny, nx = y[:, None] + dy, x[:, None] + dx
        inside = self._inside(ny, nx)
        at = b[:, None], np.clip(ny, 0, self.h - 1), np.clip(nx, 0, self.w - 1)
        squares, cells = np.ascontiguousarray(self.sums[:, at[0], at[1], at[2]].transpose(1, 0, 2)), self.cost[at]
        tps_b = (self.stencil[y, x].reshape(len(y), 25)[..., None] * np.where(inside[..., None], self.v[at], 0)).sum(1)

        old = self._terms(self.luma0[b, y, x], self.luma1[b, y, x], self.mask[b, y, x])

        def change(d: np.ndarray, k: np.ndarray) -> np.ndarray:
            out = np.empty(len(k))
            for start in range(0, len(k), BLOCK):
                some = slice(start, start + BLOCK)
                own = k[some]
                out[some] = self._change(b[own], y[own], x[own], d[some], tps_b[own], squares[own].transpose(1, 0, 2), inside[own], cells[own], old[:, own])
            return out

        e, each = self.eps[b], np.arange(len(y))
        ways = np.array([(-1.0, 0.0), (1.0, 0.0), (0.0, -1.0), (0.0, 1.0)])
        tried = change((ways[:, None] * e[:, None]).reshape(-1, 2), np.tile(each, 4)).reshape(4, -1)
        g = np.stack([tried[0] - tried[1], tried[2] - tried[3]], -1)
        size = np.sqrt((g * g).sum(-1))
        g = g / np.where(size > 0, size, 1)[:, None]
        low, high = np.zeros(len(y)), np.where(size > 0, self._limit(b, y, x, g), 0.0)
        left, right = high - GOLDEN * high, GOLDEN * high
        f_left, f_right = change(np.concatenate([left[:, None] * g, right[:, None] * g]), np.tile(each, 2)).reshape(2, -1)
        while (open_ := np.flatnonzero(high - low > e)).size:
            up, lo, hi, le, ri, f_le, f_ri = (c[open_] for c in (f_right < f_left, low, high, left, right, f_left, f_right))
            lo, hi = np.where(up, le, lo), np.where(up, hi, ri)
            fresh = np.where(up, lo + GOLDEN * (hi - lo), hi - GOLDEN * (hi - lo))
            value = change(fresh[:, None] * g[open_], open_)
            low[open_], high[open_], left[open_], right[open_] = lo, hi, np.where(up, ri, fresh), np.where(up, fresh, le)
            f_left[open_], f_right[open_] = np.where(up, f_ri, value), np.where(up, value, f_le)
        step, gain = np.where(f_left < f_right, left, right), np.minimum(f_left, f_right)
        some = (gain < 0) & (size > 0)
        if not some.any():
            return
        b, y, x, d = b[some], y[some], x[some], (step[:, None] * g)[some]
        delta, (self.luma0[b, y, x], self.luma1[b, y, x], self.mask[b, y, x]) = self._moved(b, y, x, d)
        self.v[b, y, x] += d
        own, cell = np.nonzero(inside[some])  # squares of one colour do not overlap
        where = tuple(np.broadcast_to(c[some], inside[some].shape)[own, cell] for c in at)
        self.sums[(slice(None), *where)] += delta[:, own]
        self.cost[where] = _ssim(*self.sums[(slice(None), *where)], self.clamp[where[0]])
        self.improving[b, y, x] = True
        moved[b] = True

    def sweep(self) -> np.ndarray:
        """Whether any pixel moved, by job."""
        moved = np.zeros(self.n, bool)
        for cy in range(5):
            for cx in range(5):
                self._colour(cy, cx, moved)
        return moved

    def run(self, most: int | np.ndarray) -> np.ndarray:
        """Sweeps until nothing moves, job by job, but no more than `most`; how many there were."""
        count, most = np.zeros(self.n, int), np.broadcast_to(most, self.n)
        active = count < most
        while active.any():
            self.improving[~active] = False
            moved = self.sweep()
            count[active] += 1
            active &= moved & (count < most)
        return count


def smaller(images: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """The next level of images: cardinal cubic B-splines."""
    rows, columns = (resize_matrix(n, m) for n, m in zip(images.shape[1:], size))
    return rows @ images @ columns.T


def larger(field: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Fields at another size: bilinear, each component longer by its axis's ratio."""
    n = field.shape[1:3]
    rows, columns = (resize_matrix(a, b, "hat", False, False) for a, b in zip(n, size))
    return np.stack([rows @ field[..., c] @ columns.T * (size[1 - c] / n[1 - c]) for c in (0, 1)], -1)


def resized_mask(mask: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Masks of the first level at another: bilinear at the centres of pixels, in whole numbers."""
    if mask.shape[1:] == size:
        return mask
    y, x = np.meshgrid(*((np.arange(m) + 0.5) * n / m - 0.5 for n, m in zip(mask.shape[1:], size)), indexing="ij")
    return np.rint(bilinear(mask, np.arange(len(mask))[:, None, None], y, x))


def morph(i0: np.ndarray, i1: np.ndarray, s: Settings | Sequence[Settings] = Settings(), masks: tuple[np.ndarray, np.ndarray] | None = None, progress=None) -> tuple[np.ndarray, list[tuple]]:
    """(fields, log) between images (b, y, x) of equal size; jobs do not touch each other, and may have settings of their
    own but for start_res. log: (level, height, width, the most sweeps of a job, sweeps by job, milliseconds).

    progress(level, fields) may return False to stop.
    """
    n, *size = i0.shape
    own = [s] * n if isinstance(s, Settings) else list(s)
    if len({o.start_res for o in own}) > 1:
        raise ValueError("jobs that go side by side have one start_res")
    sizes = level_sizes(*size, own[0].start_res) if n else [tuple(size)]
    images = [(i0, i1)]
    for after in sizes[1:]:
        images.append(tuple(smaller(i, after) for i in images[-1]))  # type: ignore[arg-type]
    field = np.stack([coarse_field(list(o.points), *sizes[-1], o.boundary, o.w_tps, o.w_ui) if o.points else np.zeros((*sizes[-1], 2)) for o in own]) if n else np.zeros((0, *sizes[-1], 2))
    most, log = np.array([o.max_iter for o in own], int), []
    for level in range(len(sizes) - 2, -1, -1):
        began = time.perf_counter()
        most = np.array([int(m / o.drop) for m, o in zip(most, own)], int)
        state = Level(*images[level], larger(field, sizes[level]), own, None if masks is None else tuple(resized_mask(m, sizes[level]) for m in masks))
        sweeps = state.run(most)
        log.append((level, *sizes[level], int(sweeps.max(initial=0)), sweeps, 1000 * (time.perf_counter() - began)))
        field = state.v
        if progress and progress(level, field) is False:
            break
    return field, log


#: Pixels of jobs that are matched side by side, about.
TOGETHER = 1 << 17

_PARAMETERS = "w_ssim w_tps w_ui ssim_clamp max_iter drop eps start_res boundary".split()


def _arrays(df: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """A row of arrays for each raster, with its height and width."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", *channels)))
    last = F.element_at("c", -1)
    return df.groupBy(*keys).agg(cells.alias("c")).select(*keys, (last["y"] + 1).alias("high"), (last["x"] + 1).alias("wide"), *(F.col(f"c.{k}").alias(k) for k in channels))


def spread(df: DataFrame) -> int:
    """Tasks for rows that are small but long to match: as many as there are cores or shuffle partitions. Without a number,
    adaptive execution would put them together by their bytes."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def jobs(pairs: DataFrame, parameters: DataFrame | None = None, points: DataFrame | None = None, masks: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """(pair_id, layer, high, wide, v0, v1, mask0, mask1, parameters, points): a row of arrays for each layer of a pair.

    pairs: (pair_id, y, x, v0, v1), complete rasters. parameters: (pair_id, layer) and any of the fields of Settings but
    points; a null or missing one is that of `settings`. Without the table each pair has one layer, 0. points: (pair_id,
    layer, idx, lx, ly, rx, ry). masks: (pair_id, layer, y, x, mask0, mask1), 255 where the image is ignored; a layer
    without rows has none.
    """
    images = _arrays(pairs, ["pair_id"], ["v0", "v1"])
    given = set(parameters.columns) if parameters is not None else set()
    value = lambda c: F.coalesce(F.col(c), F.lit(getattr(settings, c))) if c in given else F.lit(getattr(settings, c))
    layers = parameters if parameters is not None else images.select("pair_id", F.lit(0).alias("layer"))
    out = layers.select("pair_id", "layer", *(value(c).alias(c) for c in _PARAMETERS)).join(images, "pair_id")
    if points is not None:
        each = F.transform(F.array_sort(F.collect_list(F.struct("idx", "lx", "ly", "rx", "ry"))), lambda p: F.array(p["lx"], p["ly"], p["rx"], p["ry"]))
        out = out.join(points.groupBy("pair_id", "layer").agg(each.alias("points")), ["pair_id", "layer"], "left")
    else:
        out = out.withColumn("points", F.array(*(F.array(*map(F.lit, p)) for p in settings.points)) if settings.points else F.lit(None).cast("array<array<double>>"))
    if masks is not None:
        out = out.join(_arrays(masks, ["pair_id", "layer"], ["mask0", "mask1"]).drop("high", "wide"), ["pair_id", "layer"], "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("array<double>") for c in ("mask0", "mask1")})
    return out.repartition(spread(out), "pair_id", "layer")


MATCHED = "pair_id long, layer int, high int, wide int, vx array<double>, vy array<double>, levels array<struct<level: int, high: int, wide: int, sweeps: int, ms: double>>"


def matched(work: DataFrame) -> DataFrame:
    """Of each of jobs(): the field as arrays, and level by level the sweeps and the milliseconds (the job's part of those
    that it went side by side with). To be written once where both are wanted."""

    def run(batches):
        for batch in batches:
            for (high, wide, _), part in batch.groupby(["high", "wide", "start_res"]):
                count = max(1, TOGETHER // (high * wide))
                for at in range(0, len(part), count):
                    some = part.iloc[at : at + count]
                    raster = lambda c, none=0.0: np.stack([np.full(high * wide, none) if a is None else np.asarray(a, float) for a in some[c]]).reshape(-1, high, wide)  # noqa: B023, E731
                    own = [Settings(**{c: r[c] for c in _PARAMETERS}, points=() if r["points"] is None else tuple(tuple(p) for p in r["points"])) for r in some.to_dict("records")]
                    field, log = morph(raster("v0"), raster("v1"), own, (raster("mask0"), raster("mask1")))
                    levels = [[{"level": level, "high": h, "wide": w, "sweeps": int(n[k]), "ms": ms / len(some)} for level, h, w, _, n, ms in log] for k in range(len(some))]
                    yield pd.DataFrame({
                        "pair_id": some["pair_id"].to_numpy(), "layer": some["layer"].to_numpy(), "high": high, "wide": wide,
                        "vx": list(field[..., 0].reshape(len(some), -1)), "vy": list(field[..., 1].reshape(len(some), -1)), "levels": levels,
                    })

    return work.mapInPandas(run, MATCHED)


def fields(done: DataFrame) -> DataFrame:
    """(pair_id, layer, y, x, vx, vy) of matched()."""
    cells = done.select("pair_id", "layer", "wide", F.posexplode(F.arrays_zip("vx", "vy")).alias("i", "v"))
    return cells.select("pair_id", "layer", F.expr("i div wide").cast("int").alias("y"), (F.col("i") % F.col("wide")).cast("int").alias("x"), "v.vx", "v.vy")


def schedule(done: DataFrame) -> DataFrame:
    """(pair_id, layer, level, high, wide, sweeps, ms) of matched()."""
    return done.select("pair_id", "layer", F.explode("levels").alias("l")).select("pair_id", "layer", "l.*")


def observed(done: DataFrame, name: str = "matching") -> tuple[DataFrame, Observation]:
    """matched() and what is measured while its rows are first made: jobs, sweeps, milliseconds, pixels that were visited
    and those that would be in full schedules of one sweep a level."""
    measure = lambda f: F.sum(F.aggregate("levels", F.lit(0.0), lambda s, l: s + f(l)))  # noqa: E731, E741
    seen = Observation(name)
    return done.observe(
        seen, F.count(F.lit(1)).alias("jobs"), measure(lambda l: l["sweeps"].cast("double")).alias("sweeps"), measure(lambda l: l["ms"]).alias("ms"),  # noqa: E741
        measure(lambda l: l["sweeps"] * l["high"] * l["wide"].cast("double")).alias("visits"),  # noqa: E741
    ), seen


def match(pairs: DataFrame, settings: Settings = Settings(), masks: DataFrame | None = None) -> DataFrame:
    """(pair_id, y, x, vx, vy) of pairs (pair_id, y, x, v0, v1), one layer each; masks: (pair_id, y, x, mask0, mask1)."""
    masks = None if masks is None else masks.withColumn("layer", F.lit(0))
    return fields(matched(jobs(pairs, None, None, masks, settings))).drop("layer")
