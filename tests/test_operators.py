"""Properties that hold whatever the data: inverses, sums, fixed points, shortest paths, and energies that fall."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.functions import filters
from rastrel.functions.kernels import KERNELS, kernel
from rastrel.operators import graph, lines, matching, neighbourhood, render, resample, solvers


def raster(spark, image, image_id=0):
    return spark.createDataFrame([(image_id, y, x, float(v)) for y, row in enumerate(image) for x, v in enumerate(row)], "image_id long, y int, x int, v double")


def array(df, value="v"):
    rows = df.select("y", "x", value).collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = r[value]
    return out


RNG = np.random.default_rng(3)
BUMPY = RNG.random((13, 9)) * 255


def test_kernels_sum_to_one_and_agree_with_their_derivatives():
    for name, k in KERNELS.items():
        if name.startswith("d") and "-" in name:
            base = kernel(name.split("-")[1]) if name.startswith("d-") else kernel("d-" + name.split("-")[1])
            r = np.linspace(0.05, base.support / 2 - 0.05, 50) + 0.001
            numeric = (base.at(r + 1e-5) - base.at(r - 1e-5)) / 2e-5
            assert np.allclose(numeric, k.at(r), atol=1e-3), name
        elif name not in ("crt", "parabolic", "linrev"):
            for t in (0.1, 0.3, 0.45):
                total = k.at(np.arange(-6, 7) + t).sum()
                assert abs(total - 1) < (0.02 if name in ("german",) else 1e-6), (name, total)


def test_thin_plate_stencils():
    stencils = neighbourhood.thin_plate_stencils()
    assert np.allclose(stencils.sum((2, 3)), 0) and stencils[2, 2, 2, 2] == 40
    assert stencils[2, 2].tolist() == [[0, 0, 2, 0, 0], [0, 4, -16, 4, 0], [2, -16, 40, -16, 2], [0, 4, -16, 4, 0], [0, 0, 2, 0, 0]]
    assert neighbourhood.io_mask().sum((2, 3))[2, 2] == 25 and neighbourhood.io_mask().sum((2, 3))[0, 0] == 9


def test_affine_fields_do_not_bend(spark):
    y, x = np.mgrid[:11, :8]
    got = neighbourhood.thin_plate_gradient(raster(spark, 3 * x - 2 * y + 1), 11, 8)
    assert got.agg(F.max(F.abs("tps"))).first()[0] < 1e-9


@pytest.mark.parametrize("name", ["bspline3", "bspline5", "omoms3"])
def test_inverse_filter(spark, name):
    taps = filters.sampled(name)
    back = array(lines.ifir(lines.fir(raster(spark, BUMPY), taps), taps))
    assert np.allclose(back, BUMPY, atol=1e-8)
    assert lines.fir(raster(spark, BUMPY), filters.taps("delta")).count() == BUMPY.size
    leaning = [(0, 1.0), (1, 0.5)]
    assert np.allclose(array(lines.ifir(lines.fir(raster(spark, BUMPY), leaning), leaning)), BUMPY, atol=1e-8)


def test_constant_images_stay_constant(spark):
    df = raster(spark, np.full((13, 9), 7.0))
    for out in (
        lines.scale(df, 13, 9, 6, 4), lines.scale(df, 13, 9, 6, 4, "mitchell_netravali"), resample.upsample(df, 13, 9, 20, 14, "bspline3"), resample.area_average(df, 2),
        resample.downsample_cells(df, 13, 9, 6, 4), lines.gaussian_blur(df, 1.5), resample.build_pyramid(df, 13, 9, 3), lines.convolve(df, [(-1, 0.25), (0, 0.5), (1, 0.25)]),
    ):
        low, high = out.agg(F.min("v"), F.max("v")).first()
        assert abs(low - 7) < 1e-6 and abs(high - 7) < 1e-6


def test_narrow_images(spark):
    thin = raster(spark, BUMPY[:, :1])
    assert neighbourhood.neighbour_count(thin).agg(F.max("n")).first()[0] == 5
    assert np.allclose(array(lines.convolve(thin, [(-2, 0.25), (0, 0.5), (2, 0.25)]))[:, 0].shape, 13)
    assert array(neighbourhood.derivatives(thin), "dx").max() == 0


def test_recursive_gaussian(spark):
    (b1, a1), (b2, a2, a3) = filters.recursive_weights(2.0)
    assert abs(b1 / (1 - a1) - 1) < 1e-12 and abs(b2 / (1 - a2 - a3) - 1) < 1e-12
    impulse = np.zeros((1, 81))
    impulse[0, 40] = 1
    out = array(lines.along(raster(spark, impulse), "x", F.pandas_udf(lambda s: s.map(lambda v: lines.recursed(lines.recursed(np.asarray(v), (b1, a1)), (b2, a2, a3))), "array<double>")))[0]
    at = np.arange(81) - 40
    assert abs(out.sum() - 1) < 1e-3 and abs(math.sqrt((out * at**2).sum()) - 2) < 0.2
    taps = dict(filters.van_vliet(2.0))
    assert abs(sum(taps.values()) - 1) < 1e-9 and taps[1] == taps[-1]


def test_levels():
    assert resample.level_sizes(30, 24) == [(30, 24), (15, 12)] and resample.level_count(64, 64) == 4
    assert resample.level_sizes(29, 25, 8, "gpu") == [(29, 25), (15, 13)]


def test_matrices_match_the_plan(spark):
    rows, cols = matching.resize_matrix(13, 6), matching.resize_matrix(9, 4)
    want = rows @ BUMPY @ cols.T
    got = array(resample.build_pyramid(raster(spark, BUMPY), 13, 9, 4).where("level = 1"))
    assert np.allclose(got, want, atol=1e-8)


def test_identical_images_do_not_move():
    field, log = matching.morph(BUMPY[None], BUMPY[None], matching.Settings(start_res=4, max_iter=20))
    assert np.abs(field).max() == 0 and log


def test_energy_falls_and_shift_is_found():
    y, x = np.mgrid[:24, :24]
    smooth = lambda s: 128 + 60 * np.sin((x + s) / 2.5) * np.cos(y / 3.0) + 40 * np.cos((x + s) / 4 + y / 5)
    settings = matching.Settings(start_res=6, max_iter=40)
    level = matching.Level(smooth(0)[None], smooth(2)[None], np.zeros((1, 24, 24, 2)), settings)
    last = level.energies()[0]
    for _ in range(4):
        level.sweep()
        now = level.energies()[0]
        assert now <= last + 1e-9
        last = now
    field, _ = matching.morph(smooth(0)[None], smooth(2)[None], settings)
    inner = field[0, 8:16, 8:16, 0]
    assert abs(np.median(inner) + 1) < 0.4


def test_locked_border_and_points():
    settings = matching.Settings(start_res=4, max_iter=10, boundary="border", points=((0.4, 0.5, 0.6, 0.5),))
    field = solvers.coarse_field(list(settings.points), 16, 16, "border")
    assert np.abs(field[0]).max() < 1e-2 and field[7:9, 7:9, 0].mean() > 0.5
    level = matching.Level(BUMPY[None], BUMPY[None, ::-1], np.zeros((1, 13, 9, 2)), settings)
    level.sweep()
    assert np.abs(level.v[0, 0]).max() == np.abs(level.v[0, :, -1]).max() == 0 and np.abs(level.v).max() > 0


def test_path_solution_solves_its_system(spark):
    field = spark.createDataFrame([(k, y, x, math.sin(x + k) / 3, math.cos(y) / 4) for k in range(2) for y in range(6) for x in range(7)], "pair_id long, y int, x int, vx double, vy double")
    matrix, right = solvers.path_system(solvers.jacobian_average(field), 6, 7)
    got = {(r["pair_id"], r["y"] * 7 + r["x"]): r["ux"] for r in solvers.quadratic_path(field, 6, 7, tol=1e-8).collect()}
    for k in range(2):
        a, b = np.zeros((42, 42)), np.zeros(42)
        for r in matrix.where(f"pair_id = {k}").collect():
            a[r["row"], r["col"]] = r["value"]
        for r in right.where(f"pair_id = {k}").collect():
            b[r["row"]] = r["bx"]
        assert np.allclose(a, a.T) and np.allclose(a @ np.array([got[k, i] for i in range(42)]), b, atol=1e-5)
    still = solvers.quadratic_path(field.withColumns({"vx": F.lit(0.25), "vy": F.lit(0.0)}), 6, 7)
    assert still.agg(F.max(F.abs("ux")), F.max(F.abs("uy"))).first() == (0.0, 0.0)


def test_livewire_against_bellman_ford(spark):
    links = graph.edge_costs(raster(spark, BUMPY), ("v",))
    costs = graph.inverted(links)
    table = {(r["y"], r["x"], r["dir"]): r["cost"] for r in costs.collect()}
    far = {(y, x): math.inf for y in range(13) for x in range(9)}
    far[2, 2] = 0.0
    for _ in range(len(far)):
        for (y, x, d), c in table.items():
            to = (y + graph.DIRECTIONS[d][0], x + graph.DIRECTIONS[d][1])
            if to in far and far[y, x] + c < far[to]:
                far[to] = far[y, x] + c
    path = graph.livewire(costs, (2, 2), (11, 7)).orderBy("step").collect()
    assert (path[0]["y"], path[0]["x"], path[-1]["y"], path[-1]["x"]) == (2, 2, 11, 7)
    assert abs(path[-1]["distance"] - far[11, 7]) < 1e-9
    near = graph.livewire(costs, (2, 2), (50, 50), radius=3).orderBy("step").collect()
    assert (near[-1]["y"], near[-1]["x"]) == (5, 5)


def test_frames(spark):
    zero = np.zeros((13, 9, 2))
    assert np.allclose(render.morph_frame(BUMPY, BUMPY, zero, zero, 0.3), BUMPY)
    assert np.allclose(render.morph_frame(BUMPY, BUMPY * 0, zero, zero, 0.0), BUMPY) and np.allclose(render.morph_frame(BUMPY, BUMPY * 0, zero, zero, 1.0), 0)
    assert render.frame_schedule(2, 9) == [48, 49, 50, 51, 52, 51, 50, 49, 48] and render.frame_schedule(0, 2) == [50, 50]
    canvas = solvers.filled_margin(solvers.extended_canvas(raster(spark, np.full((10, 10), 5.0)), 10, 10))
    assert canvas.count() == 14 * 14 and canvas.agg(F.max("v")).first()[0] == 5.0


def test_random_polygons(spark):
    rng = random.Random(2)
    corners = [(rng.uniform(0, 9), rng.uniform(0, 13)) for _ in range(7)]
    got = {(r["y"], r["x"]) for r in graph.inside_polygons(raster(spark, BUMPY), {1: corners}).where("size(polygons) = 1").collect()}

    def inside(px, py):
        odd = False
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            if (ay <= py) != (by <= py) and px < ax + (py - ay) * (bx - ax) / (by - ay):
                odd = not odd
        return odd

    assert got == {(y, x) for y in range(13) for x in range(9) if inside(x, y)}


def test_recursive_filter_borders():
    line = np.full(20, 3.0)
    for border in ("edge", "repeat", "reflect"):
        assert np.allclose(lines.recursed(line, (0.25, 0.75), border), 3.0, atol=1e-6)
    assert lines.recursed(line, (0.25, 0.75), "zero")[0] < 3
    with pytest.raises(ValueError):
        lines.recursive_filter(None, (0.5, 0.5), "none")


def test_masked_similarity(spark):
    from rastrel.operators import energy

    other = BUMPY.copy()
    other[:, :4] = 0
    rows = [(0, y, x, float(BUMPY[y, x]), float(other[y, x]), 0.0 if x < 4 else 1.0) for y in range(13) for x in range(9)]
    df = spark.createDataFrame(rows, "pair_id long, y int, x int, v0 double, v1 double, m double")
    assert energy.ssim(df, weight="m").agg(F.max("ssim")).first()[0] < 1e-9
    assert energy.ssim(df).agg(F.max("ssim")).first()[0] > 0.5


def test_points_pull_towards_their_targets(spark):
    from rastrel.operators import energy
    from rastrel.sources import rasters

    field = spark.createDataFrame([(0, y, x, 0.0, 0.0) for y in range(8) for x in range(8)], "pair_id long, y int, x int, vx double, vy double")
    got = {(r["y"], r["x"]): (r["ui_a"], -r["ui_bx"] / 2, -r["ui_by"] / 2) for r in energy.control_point_terms(field, rasters.control_points(spark), 8, 8).collect()}
    want = {}
    for y, x, w, tx, ty in solvers.point_terms([p[1:] for p in rasters.CONTROL_POINTS], 8, 8):
        a, b, c = want.get((y, x), (0.0, 0.0, 0.0))
        want[y, x] = (a + w, b + w * tx, c + w * ty)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_extensions(spark):
    from rastrel.functions.vectors import extended

    with pytest.raises(ValueError):
        extended(F.lit(1), F.lit(3), "elsewhere")
    with pytest.raises(ValueError):
        kernel("no such kernel")
    with pytest.raises(ValueError):
        filters.taps("no such filter")


def test_pairs_side_by_side_equal_pairs_alone(spark):
    settings = matching.Settings(start_res=4, max_iter=8)
    images = np.random.default_rng(5).random((4, 2, 13, 9)) * 255
    together, _ = matching.morph(images[:, 0], images[:, 1], settings)
    for k, (a, b) in enumerate(images):
        alone, _ = matching.morph(a[None], b[None], settings)
        assert np.allclose(alone[0], together[k])
    rows = [(k, y, x, float(a[y, x]), float(b[y, x])) for k, (a, b) in enumerate(images) for y in range(13) for x in range(9)]
    got = matching.match(spark.createDataFrame(rows, "pair_id long, y int, x int, v0 double, v1 double"), settings).collect()
    assert len(got) == len(rows) and all(np.allclose((r["vx"], r["vy"]), together[r["pair_id"], r["y"], r["x"]]) for r in got)


def slow_recursed(line, weights, border, pad):
    """The sweeps over a line that is laid out far beyond its ends."""
    b, *a = weights
    x = np.pad(line, pad, mode={"edge": "edge", "repeat": "wrap", "reflect": "symmetric"}[border])
    for _ in range(2):
        y = np.zeros(x.size + len(a))
        for n in range(x.size):
            y[n + len(a)] = b * x[n] + sum(w * y[n + len(a) - 1 - k] for k, w in enumerate(a))
        x = y[len(a) :][::-1]
    return x[pad : x.size - pad]


@pytest.mark.parametrize("sigma", [0.8, 2.0, 20.0, 80.0])
def test_recursion_goes_on_beyond_the_ends(sigma):
    rng = np.random.default_rng(1)
    for weights in filters.recursive_weights(sigma):
        for n in (1, 2, 3, 37):
            line = rng.random(n)
            for border in ("edge", "repeat", "reflect"):
                assert np.allclose(lines.recursed(line, weights, border), slow_recursed(line, weights, border, int(60 * sigma) + 40), atol=1e-9), (sigma, n, border)


@pytest.mark.parametrize("border", ["edge", "repeat", "reflect"])
def test_blur_of_a_constant_is_constant(spark, border):
    flat = raster(spark, np.ones((3, 200)))
    assert np.allclose(array(lines.gaussian_blur(flat, 80.0, border)), 1.0, atol=1e-9)


def test_tiles_give_what_whole_images_do(spark, monkeypatch):
    image = np.random.default_rng(2).random((23, 7))
    df = raster(spark, image)
    sums = {"s": F.col("v"), "n": F.lit(1)}
    whole = neighbourhood.box(df, sums), neighbourhood.neighbours(df, {"up": ("v", -2, 1), "down": ("v", 1, 0)}), neighbourhood.derivatives(df)
    whole = [sorted(map(tuple, d.select(*sorted(d.columns)).collect()), key=repr) for d in whole]
    monkeypatch.setattr(neighbourhood, "TILE", 4)
    tiled = neighbourhood.box(df, sums), neighbourhood.neighbours(df, {"up": ("v", -2, 1), "down": ("v", 1, 0)}), neighbourhood.derivatives(df)
    for want, d in zip(whole, tiled):
        got = sorted(map(tuple, d.select(*sorted(d.columns)).collect()), key=repr)
        assert len(got) == len(want) and all(np.allclose(np.array(g, float), np.array(w, float), equal_nan=True) for g, w in zip(got, want))
    assert df.rdd.getNumPartitions() >= 1 and "__t" in tiled[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("border", ["clamp", "fill"])
def test_squares_sample_as_taps_do(spark, monkeypatch, border):
    """Points that lead anywhere, also far outside, over images of several squares with missing and null pixels."""
    monkeypatch.setattr(resample, "SQUARE", 4)
    monkeypatch.setattr(resample, "CHUNK", 64)
    rng = np.random.default_rng(11)
    cells = [(k, y, x, None if rng.random() < 0.05 else float(rng.random())) for k in ("a", "b") for y in range(11) for x in range(9) if rng.random() > 0.05]
    img = spark.createDataFrame(cells, "image_id string, y int, x int, v double")
    places = [(k, y, x, *map(float, rng.normal(5, 6, 2))) for k in ("a", "b", "none") for y in range(11) for x in range(9)] + [("a", 20, 20, None, 1.0), ("b", 21, 21, 2.0, 3.0)]
    at = spark.createDataFrame(places, "image_id string, y int, x int, px double, py double")
    for k, order in (("keys4", (0, 0)), ("bspline3", (1, 0)), ("bspline3", (1, 1)), ("bspline3", (0, 2))):
        dx, dy = (kernel("d" * o + ("-" if o else "") + k) for o in order)
        found = [
            {(r["image_id"], r["y"], r["x"]): r["u"] for r in way(at, img, F.col("px"), F.col("py"), {"u": "v"}, 11, 9, 2, (dx, dy), border, 255.0, ("image_id",), False).collect()}
            for way in (resample._by_taps, resample._by_squares)
        ]
        assert set(found[0]) == set(found[1]) and ("a", 20, 20) not in found[1]
        assert max(abs(found[0][p] - found[1][p]) for p in found[0]) < 1e-9
    empty = resample.sample(at.limit(0), img, F.col("px"), F.col("py"), {"u": "v"}, 11, 9, "keys4", border)
    assert empty.columns == ["image_id", "y", "x", "u"] and not empty.count()
