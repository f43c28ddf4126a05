"""The matcher for images too large for one task: a level's field is improved window by window, many tasks an image.

Field and images are tables of square blocks. A launch lays windows over the images, four pixels apart, so that nothing
that a pixel of one reads is changed by another, and moves the pixels in them as the matcher does. Four launches, shifted
by half a window in either direction, reach every pixel. Between launches the windows meet their surroundings again:
blocks of the field around them, and those blocks of the images to which the field points, by joins on block numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.operators.matching import Level, Settings, Window
from rastrel.operators.resample import build_pyramid, level_sizes, upsample_field
from rastrel.operators.solvers import coarse_solve
from rastrel.tables import Written

#: Side of a block and of a window.
BLOCK = WINDOW = 256
#: Pixels between windows, and around a window those that its squares and stencils read.
GAP, HALO = 4, 4
#: Pixels around the places that a window's field points to, and sweeps of a window in one launch.
SLACK, SWEEPS = 10, 4

_FIELD = "pair_id long, by int, bx int, top int, left int, high int, wide int, vx array<double>, vy array<double>, moved long"
_NAMES = [c.split()[0] for c in _FIELD.split(", ")]


def blocks(df: DataFrame, columns: list[str], side: int) -> DataFrame:
    """(pair_id, by, bx, top, left, high, wide, columns): squares of a raster (pair_id, y, x, columns) as arrays."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", *columns)))
    rows = df.groupBy("pair_id", F.expr(f"y div {side}").cast("int").alias("by"), F.expr(f"x div {side}").cast("int").alias("bx")).agg(cells.alias("c"))
    first, last = F.element_at("c", 1), F.element_at("c", -1)
    return rows.select(
        "pair_id", "by", "bx", first["y"].alias("top"), first["x"].alias("left"), (last["y"] - first["y"] + 1).alias("high"), (last["x"] - first["x"] + 1).alias("wide"),
        *(F.col(f"c.{k}").alias(k) for k in columns),
    )


def pixels(squares: DataFrame, columns: list[str]) -> DataFrame:
    """(pair_id, y, x, columns) of blocks."""
    cells = squares.select("pair_id", "top", "left", "wide", F.posexplode(F.arrays_zip(*columns)).alias("i", "c"))
    y, x = F.col("top") + F.expr("i div wide").cast("int"), F.col("left") + (F.col("i") % F.col("wide")).cast("int")
    return cells.select("pair_id", y.alias("y"), x.alias("x"), *(F.col(f"c.{k}").alias(k) for k in columns))


def _spans(low: int, high: int, size: int, shift: int, side: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of the windows along an axis whose surroundings meet low..high."""
    period = side + GAP
    for k in range((low - shift - side - HALO) // period, (high - shift + HALO) // period + 1):
        start, end = max(0, k * period + shift), min(size, k * period + shift + side)
        if start < end and start - HALO < high and end + HALO > low:
            yield k, start, end


def _parts(arrays: list[np.ndarray], box: tuple[int, int, int, int], to: tuple[int, int, int, int]) -> tuple[tuple[int, int, int, int], list[np.ndarray]]:
    """What arrays over a box (top, left, bottom, right) have of another."""
    top, left, bottom, right = max(box[0], to[0]), max(box[1], to[1]), min(box[2], to[2]), min(box[3], to[3])
    cut = (slice(top - box[0], bottom - box[0]), slice(left - box[1], right - box[1]))
    return (top, left, bottom, right), [a[cut] for a in arrays]


_PIECE = "pair_id long, wy int, wx int, kind int, top int, left int, high int, wide int, a array<double>, b array<double>"
_REACH = "pair_id long, wy int, wx int, kind int, y0 int, y1 int, x0 int, x1 int"


def _launch(field: DataFrame, images: DataFrame, settings: Settings, size: tuple[int, int], shift: tuple[int, int], window: int, block: int) -> DataFrame:
    """The blocks of the field after the pixels of one set of windows have moved."""
    height, width = size

    def cut(batches: Iterator[pd.DataFrame], told) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                box = (r.top, r.left, r.top + r.high, r.left + r.wide)
                both = [np.asarray(a, float).reshape(r.high, r.wide) for a in (r.vx, r.vy)]
                for wy, y0, y1 in _spans(box[0], box[2], height, shift[0], window):
                    for wx, x0, x1 in _spans(box[1], box[3], width, shift[1], window):
                        rows += told(r.pair_id, wy, wx, *_parts(both, box, (y0 - HALO, x0 - HALO, y1 + HALO, x1 + HALO)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in (_PIECE if told is piece else _REACH).split(", ")])

    def piece(pair, wy, wx, at, both):
        return [(pair, wy, wx, 2, at[0], at[1], at[2] - at[0], at[3] - at[1], both[0].ravel(), both[1].ravel())]

    def reach(pair, wy, wx, at, both):
        y, x = np.mgrid[at[0] : at[2], at[1] : at[3]]
        out = []
        for k, sign in ((0, -1), (1, 1)):
            py, px = (np.clip(c + sign * v, 0, n - 1) for c, v, n in ((y, both[1], height), (x, both[0], width)))
            out.append((pair, wy, wx, k, int(py.min()) - SLACK, int(py.max()) + SLACK + 1, int(px.min()) - SLACK, int(px.max()) + SLACK + 1))
        return out

    around = field.mapInPandas(lambda b: cut(b, piece), _PIECE)
    wanted = field.mapInPandas(lambda b: cut(b, reach), _REACH).groupBy("pair_id", "wy", "wx", "kind").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    numbers = lambda low, high, n: F.sequence(F.greatest(F.lit(0), F.floor(F.col(low) / block)).cast("int"), F.least(F.lit((n - 1) // block), F.floor(F.col(high) / block)).cast("int"))
    asked = wanted.withColumn("by", F.explode(numbers("y0", "y1", height))).withColumn("bx", F.explode(numbers("x0", "x1", width))).drop("y0", "y1", "x0", "x1")
    shown = asked.join(images, ["pair_id", "kind", "by", "bx"]).select("pair_id", "wy", "wx", "kind", "top", "left", "high", "wide", F.col("v").alias("a"), F.col("mask").alias("b"))

    def laid(part: pd.DataFrame) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
        top, left = int(part["top"].min()), int(part["left"].min())
        shape = (int((part["top"] + part["high"]).max()) - top, int((part["left"] + part["wide"]).max()) - left)
        out = np.zeros((2, *shape))
        for r in part.itertuples(index=False):
            at = (slice(r.top - top, r.top - top + r.high), slice(r.left - left, r.left - left + r.wide))
            for k, a in enumerate((r.a, r.b)):
                out[k][at] = np.asarray(a, float).reshape(r.high, r.wide)
        return (top, left), out[0], out[1]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pair, wy, wx = key
        (top, left), vx, vy = laid(part[part["kind"] == 2])
        (first, i0, m0), (second, i1, m1) = (laid(part[part["kind"] == k]) for k in (0, 1))
        period = window + GAP
        rows, columns = ((max(0, k * period + s), min(n, k * period + s + window)) for k, s, n in ((wy, shift[0], height), (wx, shift[1], width)))
        at = Window(height, width, top, left, first, second, tuple(r - top for r in rows), tuple(c - left for c in columns), (SLACK - 1) / SWEEPS)
        before = np.stack([vx, vy], -1)
        level = Level(i0[None], i1[None], before[None], settings, (m0[None], m1[None]), at)
        level.run(SWEEPS)
        out, box = [], (top, left, top + vx.shape[0], left + vx.shape[1])
        changed = (level.v[0] != before).any(-1)
        for by in range(rows[0] // block, (rows[1] - 1) // block + 1):
            for bx in range(columns[0] // block, (columns[1] - 1) // block + 1):
                to = (max(rows[0], by * block), max(columns[0], bx * block), min(rows[1], (by + 1) * block), min(columns[1], (bx + 1) * block))
                (t, l_, b, r), (px, py, c) = _parts([level.v[0, ..., 0], level.v[0, ..., 1], changed], box, to)
                out.append((pair, by, bx, t, l_, b - t, r - l_, px.ravel(), py.ravel(), int(c.sum())))
        return pd.DataFrame(out, columns=_NAMES)

    moved = around.unionByName(shown).groupBy("pair_id", "wy", "wx").applyInPandas(run, _FIELD)

    def over(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(size=part["high"] * part["wide"]).sort_values(["old", "size"], ascending=False)
        whole = part.iloc[0]
        vx, vy = (np.array(whole[c], float).reshape(whole["high"], whole["wide"]) for c in ("vx", "vy"))
        for r in part.iloc[1:].itertuples(index=False):
            at = (slice(r.top - whole["top"], r.top - whole["top"] + r.high), slice(r.left - whole["left"], r.left - whole["left"] + r.wide))
            vx[at], vy[at] = (np.asarray(a, float).reshape(r.high, r.wide) for a in (r.vx, r.vy))
        return pd.DataFrame([(*key, whole["top"], whole["left"], whole["high"], whole["wide"], vx.ravel(), vy.ravel(), int(part["moved"].iloc[1:].sum()))], columns=_NAMES)

    both = field.withColumn("old", F.lit(True)).unionByName(moved.withColumn("old", F.lit(False)))
    return both.groupBy("pair_id", "by", "bx").applyInPandas(over, _FIELD)


def improved(field: DataFrame, pairs: DataFrame, size: tuple[int, int], settings: Settings, rounds: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(pair_id, y, x, vx, vy) of a level, until a round of four launches moves nothing or there were `rounds` of them.

    field: (pair_id, y, x, vx, vy); pairs: (pair_id, y, x, v0, v1) and, if there are masks, mask0 and mask1.
    """
    keep = Written(field.sparkSession, "tiles")
    masked = "mask0" in pairs.columns
    each = [pairs.select("pair_id", "y", "x", F.col(f"v{k}").alias("v"), (F.col(f"mask{k}") if masked else F.lit(0.0)).cast("double").alias("mask")) for k in (0, 1)]
    images = keep.put(each[0].transform(lambda d: blocks(d, ["v", "mask"], block)).withColumn("kind", F.lit(0)).unionByName(blocks(each[1], ["v", "mask"], block).withColumn("kind", F.lit(1))))
    now = keep.put(blocks(field, ["vx", "vy"], block).withColumn("moved", F.lit(0).cast("long")).select(*_NAMES))
    half = (window + GAP) // 2
    for _ in range(rounds):
        total = 0
        for shift in ((0, 0), (0, half), (half, 0), (half, half)):
            now = keep.put(_launch(now, images, settings, size, shift, window, block))
            total += now.agg(F.sum("moved")).first()[0] or 0
            if keep.count > 3:
                keep.drop(1)
        if not total:
            break
    return pixels(now, ["vx", "vy"])


def matched(pairs: DataFrame, height: int, width: int, settings: Settings = Settings(), window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(pair_id, y, x, vx, vy): the whole schedule, coarse to fine, each level by windows. A level has as many rounds as
    the matcher has sweeps, of which a launch makes SWEEPS."""
    sizes = level_sizes(height, width, settings.start_res)
    levels = [build_pyramid(pairs, height, width, settings.start_res, value=c, keys=("pair_id",)) for c in ("v0", "v1")]
    field = coarse_solve(pairs, list(settings.points), *sizes[-1], settings.boundary)
    most = settings.max_iter
    for level in range(len(sizes) - 2, -1, -1):
        most = int(most / settings.drop)
        both = [d.where(F.col("level") == level).drop("level") for d in levels]
        field = upsample_field(field, *sizes[level + 1], *sizes[level])
        field = improved(field, both[0].join(both[1], ["pair_id", "y", "x"]), sizes[level], settings, -(-most // SWEEPS), window, block)
    return field
