"""Filters with inverses, composed kernels, block-wise sweeps, pyramids in linear light, and solvers by tiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel import catalog, pyramid
from rastrel.functions import bands, composed, filters
from rastrel.functions.kernels import KERNELS
from rastrel.operators import grid_solvers, lines, neighbourhood, pyramids, solvers
from rastrel.plans.scaling_queries import _cardinal, _filter
from rastrel.sources import images
from rastrel.tables import Written
from tests.conftest import DATA


def raster(spark, a, key="image_id", value="v"):
    rows = [(k, y, x, float(v)) for k, image in enumerate(a) for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, f"{key} long, y int, x int, {value} double").repartition(5)


def arrays(df, shape, value="v", key="image_id"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r[key], r["y"], r["x"]] = r[value]
    return out


LEANING = ((-2, 0.1), (-1, 0.2), (0, 1.0), (1, -0.35))


@pytest.mark.parametrize("taps", [LEANING, ((0, 1.0), (1, 0.4)), tuple(filters.taps("ifir_condat1")), tuple(filters.taps("ifir_blu35"))])
@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_banded_inverse(taps, n):
    dense = _filter(list(taps), n)
    reach = max(abs(k) for k, _ in taps)
    banded = bands.band(taps, n)
    assert all(math.isclose(dense[i, j], banded[i, j - i + reach] if abs(j - i) <= reach else 0.0, abs_tol=1e-12) for i in range(n) for j in range(n))
    made = np.random.default_rng(n).standard_normal((4, n))
    assert np.allclose(bands.inverted(made, taps), np.linalg.solve(dense, made.T).T, atol=1e-9)
    assert np.allclose(bands.filtered(made, taps), made @ dense.T)


def test_pivots_that_are_too_small_raise(spark):
    with pytest.raises(ValueError, match="pivot 0"):
        bands.inverted(np.ones((1, 5)), ((0, 1.0), (-1, -1.0)))
    df = raster(spark, np.ones((1, 4, 4)))
    with pytest.raises(Exception, match="pivot"):
        lines.ifir(df, [(0, 1.0), (-1, -1.0)]).collect()


@pytest.mark.parametrize("name", ["bspline3", "bspline5", "omoms3", "mitchell_netravali"])
def test_composed_kernels_go_through_the_values(spark, name):
    a = np.random.default_rng(2).random((2, 9, 12))
    k = composed.interpolating(name)
    same = lines.reconstructed(raster(spark, a), 9, 12, 9, 12, k)
    assert np.allclose(arrays(same, a.shape), a, atol=1e-9)
    thrice = arrays(lines.reconstructed(raster(spark, a), 9, 12, 27, 36, k), (2, 27, 36))
    assert np.allclose(thrice[:, 1::3, 1::3], a, atol=1e-9)  # every third place is a pixel's centre
    alone = k.cardinal()
    assert np.allclose(alone.at(np.arange(-6, 7)), np.arange(-6, 7) == 0, atol=3e-3) and alone.support > k.support
    wide = arrays(lines.along(raster(spark, a), "x", lambda line: lines.resized(line, 36, alone, "mirror", normalise=False)), (2, 9, 36))
    assert np.allclose(wide, a @ _cardinal(12, 36, name).T, atol=2e-2) and np.allclose(wide[:, :, 1::3], a, atol=2e-2)


def test_kinds_of_kernels():
    assert composed.simple("hat").cardinal().weights == ((0, 1.0),)
    k = composed.generalized(filters.taps("fir_dalai1"), filters.sampled("bspline3"), "bspline3")
    assert (k.support, k.normalize, k.name) == (4, False, "bspline3*fir*ifir^-1")
    assert composed.simple("crt").normalize and len(KERNELS) > 30


@pytest.mark.parametrize("border", lines.BORDERS)
def test_sweeps_by_blocks(spark, border):
    weights = (0.25, 1.1, -0.35) if border in ("edge", "reflect") else (0.5, 0.5)
    rng = np.random.default_rng(3)
    for n, span in ((1, 4), (11, 4), (12, 100)):
        a = rng.standard_normal((2, 3, n))
        want = np.stack([lines.recursed_lines(image, weights, border) for image in a])
        got = arrays(lines.swept_by_blocks(raster(spark, a), "x", weights, border, span), a.shape)
        assert np.allclose(got, want, atol=1e-9), (n, span)
    a = rng.standard_normal((1, 17, 2))
    want = lines.recursed_lines(a[0].T, weights, border).T
    assert np.allclose(arrays(lines.swept_by_blocks(raster(spark, a), "y", weights, border, 5), a.shape)[0], want, atol=1e-9)


def curve(v):
    return np.where(v <= 0.0031308, 12.92 * v, 1.055 * np.maximum(v, 0) ** (1 / 2.4) - 0.055)


def uncurve(v):
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def colours(spark, a, more=()):
    rows = [(k, y, x, *(int(v) for v in a[k, y, x]), *(float(m[y, x]) for m in more)) for k in range(len(a)) for y in range(a.shape[1]) for x in range(a.shape[2])]
    names = "image_id long, y int, x int, r int, g int, b int" + "".join(f", {n} double" for n in ("ignore", "outside")[: len(more)])
    return spark.createDataFrame(rows, names)


def test_levels_in_bytes(spark, monkeypatch):
    a = np.random.default_rng(6).integers(0, 256, (2, 35, 22, 3))
    ignore, outside = np.zeros((35, 22)), np.zeros((35, 22))
    ignore[:, :2], outside[:, :5] = 255, 255
    puts = []
    put = Written.put
    monkeypatch.setattr(Written, "put", lambda self, df: puts.append(1) or put(self, df))
    got = pyramids.byte_levels(colours(spark, a, (ignore, outside)), 35, 22, 5).collect()
    assert len(puts) == 2  # a level each
    light = uncurve(a / 255)
    light[:, (ignore == 0) & (outside > 0)] = 1.0
    sizes, want = [(35, 22), (17, 11), (8, 5)], {0: a}
    for level in (1, 2):
        (h, w), (nh, nw) = sizes[level - 1], sizes[level]
        light = np.einsum("ij,kjlc->kilc", _cardinal(h, nh), np.einsum("ij,kljc->klic", _cardinal(w, nw), light))
        want[level] = 255 * curve(np.clip(light, 0, 1))
    assert len(got) == 2 * sum(h * w for h, w in sizes)
    for r in got:
        w = want[r["level"]][r["image_id"], r["y"], r["x"]]
        assert all(v == math.floor(x) or abs(x - round(x)) < 1e-6 for v, x in zip((r["r"], r["g"], r["b"]), w))
        assert r["gray"] == (4899 * r["r"] + 9617 * r["g"] + 1868 * r["b"] + 8192) >> 14 and abs(r["gray"] - (0.299 * r["r"] + 0.587 * r["g"] + 0.114 * r["b"])) < 0.6


def test_halving_program(spark, tmp_path):
    a = np.random.default_rng(7).integers(0, 256, (37, 25, 3)).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.png").write_bytes(images.png(a))
    assert pyramid.run(spark, str(tmp_path / "in"), str(tmp_path / "out")) > 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1.bmp", "2.bmp"]
    back = images.read_images(spark, str(tmp_path / "out" / "1.bmp")).collect()
    assert {(r["height"], r["width"]) for r in back} == {(19, 13)} and len(back) == 19 * 13
    (tmp_path / "in" / "two.png").write_bytes(images.png(a[:20, :20]))
    pyramid.run(spark, str(tmp_path / "in"), f"file://{tmp_path}/both")
    assert sorted(p.name for p in (tmp_path / "both").iterdir()) == ["one-1.bmp", "one-2.bmp", "two-1.bmp", "two-2.bmp"]


def bent(k, h, w):
    y, x = np.mgrid[:h, :w]
    return np.stack([0.6 * np.sin(x / 3.0 + k) * np.cos(y / 4), 0.5 * np.cos(y / 3.5 + x / 5 + k)], -1)


def field_of(spark, fields):
    rows = [(k, y, x, float(f[y, x, 0]), float(f[y, x, 1])) for k, f in enumerate(fields) for y in range(f.shape[0]) for x in range(f.shape[1])]
    return spark.createDataFrame(rows, "pair_id long, y int, x int, vx double, vy double").repartition(6)


def dense_path(spark, field, h, w):
    matrix, right = solvers.path_system(solvers.jacobian_average(field), h, w)
    n = field.select("pair_id").distinct().count()
    a, b = np.zeros((n, h * w, h * w)), np.zeros((n, h * w, 2))
    for r in matrix.collect():
        a[r["pair_id"], r["row"], r["col"]] = r["value"]
    for r in right.collect():
        b[r["pair_id"], r["row"]] = r["bx"], r["by"]
    return np.linalg.solve(a, b).reshape(n, h, w, 2)


def test_gradients_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbourhood, "TILE", 4)
    h, w = 11, 7
    field = field_of(spark, [bent(0, h, w), np.full((h, w, 2), 0.25)])
    want = dense_path(spark, field, h, w)
    found = grid_solvers.path(field, h, w, tol=1e-8)
    got = np.stack([arrays(found.values, want.shape[:3], c, "pair_id") for c in ("ux", "uy")], -1)
    assert np.abs(got - want).max() < 1e-6 and found.rounds > 5
    assert np.abs(got[1]).max() == 0  # nothing to bend
    plan = found.values._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan


def test_nested_grids_take_fewer_rounds(spark):
    h, w = 20, 16
    turn = np.add.outer(np.arange(h) / 30, np.arange(w) / 25)
    field = field_of(spark, [0.96 * np.stack([np.cos(turn), np.sin(turn)], -1)])
    plain = grid_solvers.path(field, h, w, tol=1e-3)
    nested = grid_solvers.multilevel_path(field, h, w, tol=1e-3, start_res=8)
    assert [s[:2] for s in nested.by_level] == [(10, 8), (20, 16)] and nested.rounds < plain.rounds
    system = grid_solvers.path_of(field, h, w)
    for found in (plain, nested):
        r = grid_solvers.residual(system, found.values, {"ux": "bx", "uy": "by"}).first()
        assert r["ux"] <= 1.01e-3 and r["uy"] <= 1.01e-3


def test_margin_to_its_end(spark):
    a = np.random.default_rng(8).random((2, 15, 10)) * 255
    canvas = solvers.extended_canvas(raster(spark, a), 15, 10)
    h, w = 21, 16
    plain, nested = (grid_solvers.margin(canvas, h, w, 1e-4, nested=n) for n in (False, True))
    assert nested.rounds < plain.rounds and len(nested.by_level) == 3
    system = grid_solvers.margin_system(canvas)
    for found in (plain, nested):
        worst = grid_solvers.residual(system, found.values, {"v": "right"}, ("image_id",)).agg(F.max("v")).first()[0]
        assert worst <= 1.01e-4
    got = arrays(nested.values, (2, h, w))
    assert np.abs(got - arrays(solvers.filled_margin(canvas, 1e-8), (2, h, w))).max() < 0.5
    assert np.allclose(got[:, 3:18, 3:13], a) and np.isfinite(got).all()
    inner = got[:, 1:-1, 1:-1] * 4 - got[:, :-2, 1:-1] - got[:, 2:, 1:-1] - got[:, 1:-1, :-2] - got[:, 1:-1, 2:]
    assert np.abs(inner[:, :2]).max() < 0.5  # Laplace's equation above the image


def test_small_canvases_need_no_rounds(spark):
    """Their margins are one lazy plan, whatever the number of images; nested grids begin with them."""
    spark.sparkContext.setJobGroup("margins", "margins")
    try:
        catalog.QUERIES["filled_canvas"](spark, DATA)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("margins")) <= 2
    canvas = spark.range(3 * 144).selectExpr("id div 144 AS image_id", "cast(id % 144 div 12 AS int) AS y", "cast(id % 12 AS int) AS x", "cast(id * 37 % 101 AS double) AS v").selectExpr("*", "y BETWEEN 3 + image_id AND 8 AND x BETWEEN 2 AND 7 AS held")
    want = {(r["image_id"], r["y"], r["x"]): r["v"] for r in solvers.filled_margin(canvas, 1e-12).collect()}
    for whole, tol, far in ((144, 1e-12, 1e-6), (40, 1e-2, 5)):
        got = grid_solvers.margin(canvas, 12, 12, tol, whole=whole).values.collect()
        assert len(got) == len(want) and all(abs(r["v"] - want[r["image_id"], r["y"], r["x"]]) < far for r in got)
