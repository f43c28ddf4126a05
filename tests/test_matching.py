"""The matcher: its query, jobs by layer, masks that move with the field, and windows of large images."""

import numpy as np

from rastrel import catalog
from rastrel.operators import matching, neighbourhood, render, tiled_matching
from rastrel.sources import project
from tests.conftest import DATA


def test_morph_pair_runs_the_default_schedule(spark, tmp_path):
    few = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 8")
    few.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["pair_id"], r["y"], r["x"]): (r["vx"], r["vy"]) for r in catalog.QUERIES["morph_pair"](spark, str(tmp_path)).collect()}
    vectors = {r["vec_id"]: (np.array(r["embedding"], float).reshape(8, 8) + 1) * 127.5 for r in few.collect()}
    images = [np.stack([vectors[2 * k + i] for k in range(4)]) for i in (0, 1)]
    field, log = matching.morph(*images, matching.Settings(start_res=4))
    assert len(got) == 4 * 64 and log[0][3] > 2
    assert all(abs(got[k, y, x][c] - field[k, y, x, c]) < 1e-3 for k, y, x in got for c in (0, 1))


def test_jobs_are_spread_over_tasks(spark):
    """Jobs are small in bytes, but long: adaptive execution must not put them together."""
    pairs = spark.range(40 * 16).selectExpr("id div 16 AS pair_id", "cast(id % 16 div 4 AS int) AS y", "cast(id % 4 AS int) AS x", "cast(id AS double) AS v0", "cast(id AS double) AS v1")
    work = matching.jobs(pairs)
    assert work.rdd.getNumPartitions() >= 4 and work.count() == 40


def scene(shift, h=26, w=23):
    y, x = np.mgrid[:h, :w]
    return 128 + 60 * np.sin((x + shift) / 2.5) * np.cos(y / 3.0) + 40 * np.cos((x + shift) / 4 + y / 5)


def slow_tap(image, y, x, outside=None):
    """Bilinear; beyond the border the nearest pixel or, if given, a value."""
    out, h, w = 0.0, *image.shape
    for a in (int(np.floor(y)), int(np.floor(y)) + 1):
        for b in (int(np.floor(x)), int(np.floor(x)) + 1):
            share = max(0.0, 1 - abs(y - a)) * max(0.0, 1 - abs(x - b))
            inside = 0 <= a < h and 0 <= b < w
            out += share * (image[min(max(a, 0), h - 1), min(max(b, 0), w - 1)] if inside or outside is None else outside)
    return out


def slow_energy(i0, i1, m0, m1, v, s):
    """The whole energy by its definition, pixel by pixel."""
    h, w = i0.shape
    p, q, m = (np.zeros((h, w)) for _ in range(3))
    for y in range(h):
        for x in range(w):
            vx, vy = v[y, x]
            p[y, x], q[y, x] = slow_tap(i0, y - vy, x - vx), slow_tap(i1, y + vy, x + vx)
            m[y, x] = (1 - slow_tap(m0, y - vy, x - vx, 255) / 255) * (1 - slow_tap(m1, y + vy, x + vx, 255) / 255)
    cost = 0.0
    for y in range(h):
        for x in range(w):
            at = np.s_[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]
            n = m[at].sum()
            if n <= 1:
                continue
            a, b = (m[at] * p[at]).sum() / n, (m[at] * q[at]).sum() / n
            va, vb = (max(0, (m[at] * c[at] ** 2).sum() / n - d * d) for c, d in ((p, a), (q, b)))
            k, sd = (m[at] * p[at] * q[at]).sum() / n - a * b, np.sqrt(va * vb)
            cost += min(max(0, 1 - (2 * sd + 58.5225) / (va + vb + 58.5225) * (abs(k) + 29.26125) / (sd + 29.26125)), 1 - s.ssim_clamp)
    bend = neighbourhood.thin_plate_matrix(h, w)
    tps = sum(v[..., c].ravel() @ bend @ v[..., c].ravel() for c in (0, 1)) / 2
    ui = 0.0
    for lx, ly, rx, ry in s.points:
        cx, cy, way = (lx + rx) * w / 2 - 0.5, (ly + ry) * h / 2 - 0.5, np.array([(rx - lx) * w / 2, (ry - ly) * h / 2])
        for y in range(h):
            for x in range(w):
                share = max(0.0, 1 - abs(y - cy)) * max(0.0, 1 - abs(x - cx))
                ui += share * ((v[y, x] ** 2).sum() - 2 * way @ v[y, x])
    return (s.w_ssim * cost + s.w_ui * ui) / (h * w) + s.w_tps * tps


def test_masks_move_with_the_field():
    """A change of energy is that of the whole energy, with masks whose edges the pixels cross, and at the border."""
    rng = np.random.default_rng(4)
    i0, i1 = rng.random((2, 13, 12)) * 255
    m0, m1 = np.zeros((2, 13, 12))
    m0[:, 6:], m1[5:9, 3:8] = 255, 128
    s = matching.Settings(points=((0.3, 0.4, 0.45, 0.5),), ssim_clamp=0.05)
    field = rng.normal(0, 0.4, (13, 12, 2))
    level = matching.Level(i0[None], i1[None], field[None], s, (m0[None], m1[None]))
    assert np.isclose(level.energies()[0], slow_energy(i0, i1, m0, m1, field, s))
    for y, x, d in ((5, 5, (0.7, -0.3)), (0, 0, (-0.6, 0.4)), (12, 6, (0.2, 0.9)), (7, 11, (1.3, 0.0))):
        b, py, px, d = np.array([0]), np.array([y]), np.array([x]), np.array([d])
        dy, dx = (a.ravel() for a in np.mgrid[-2:3, -2:3])
        ny, nx = py[:, None] + dy, px[:, None] + dx
        inside = (ny >= 0) & (ny < 13) & (nx >= 0) & (nx < 12)
        at = b[:, None], np.clip(ny, 0, 12), np.clip(nx, 0, 11)
        tps_b = (level.stencil[py, px].reshape(1, 25)[..., None] * np.where(inside[..., None], level.v[at], 0)).sum(1)
        got = level._change(b, py, px, d, tps_b, level.sums[:, at[0], at[1], at[2]], inside, level.cost[at])[0]
        moved = field.copy()
        moved[y, x] += d[0]
        assert np.isclose(got, slow_energy(i0, i1, m0, m1, moved, s) - slow_energy(i0, i1, m0, m1, field, s), atol=1e-9)


def test_sums_follow_moves():
    """What is added where pixels move is what summing everything anew gives; energy never rises."""
    masks = np.zeros((2, 26, 23))
    masks[:, :, 10:14] = 255
    s = matching.Settings(boundary="corner")
    level = matching.Level(scene(0)[None], scene(2)[None], np.zeros((1, 26, 23, 2)), s, (masks[:1], masks[1:]))
    last = level.energies()[0]
    for _ in range(3):
        assert level.sweep().all()
        fresh = matching.Level(level.i0, level.i1, level.v, s, (masks[:1], masks[1:]))
        assert np.allclose(fresh.sums, level.sums, atol=1e-6) and np.allclose(fresh.cost, level.cost, atol=1e-8)
        now = level.energies()[0]
        assert now <= last + 1e-9
        last = now
    assert np.abs(level.v[0, 0, 0]).max() == 0 < np.abs(level.v).max()


def test_pixels_are_looked_at_near_those_that_moved():
    level = matching.Level(scene(0)[None], scene(1)[None], np.zeros((1, 26, 23, 2)), matching.Settings())
    level.improving[:] = False
    level.improving[0, 7, 3] = level.improving[0, 25, 22] = True
    for cy in range(5):
        for cx in range(5):
            got = set(zip(*level._candidates(cy, cx)[1:]))
            near = {(y, x) for y in range(cy, 26, 5) for x in range(cx, 23, 5) for a, b in ((7, 3), (25, 22)) if abs(y - a) <= 2 and abs(x - b) <= 2}
            assert got == near


PROJECT = """<project><images image1="a.png" image2="b.png"/><layers num="2">
  <l0><masks mask1="" mask2=""/><parameters><weight ssim="1" tps="0.001" ui="100" ssimclamp="1"/><points image1="" image2=""/><boundary lock="0"/><debug iternum="24" dropfactor="2" eps="0.01" startres="6"/></parameters></l0>
  <l1><masks mask1="m" mask2="n"/><parameters><weight ssim="2" tps="0.05" ui="60" ssimclamp="0.9"/><points image1="0.3 0.4 0.7 0.6" image2="0.4 0.4 0.7 0.5"/><boundary lock="2"/><debug iternum="16" dropfactor="2" eps="0.02" startres="6"/></parameters></l1>
</layers></project>"""


def test_layers_of_a_project_are_matched_each_by_its_own(spark):
    """A project drives the matcher: layers of their own weights, points, masks and schedules equal each run alone."""
    told = project.parse(PROJECT)
    h, w = 26, 23
    m0, m1 = np.zeros((2, h, w))
    m0[:, 15:], m1[18:] = 255, 255
    pairs = [(scene(0), scene(2)), (scene(5), scene(4))]
    rows = [(k, y, x, float(a[y, x]), float(b[y, x])) for k, (a, b) in enumerate(pairs) for y in range(h) for x in range(w)]
    images = spark.createDataFrame(rows, "pair_id long, y int, x int, v0 double, v1 double")
    ids = spark.range(2).withColumnRenamed("id", "pair_id")
    parameters, points = (ids.join(t, how="cross") for t in (project.parameters(spark, told), project.control_points(spark, told)))
    masks = spark.createDataFrame([(k, 1, y, x, float(m0[y, x]), float(m1[y, x])) for k in range(2) for y in range(h) for x in range(w)], "pair_id long, layer int, y int, x int, mask0 double, mask1 double")
    done, seen = matching.observed(matching.matched(matching.jobs(images, parameters, points, masks)))
    done = done.cache()
    got = np.zeros((2, 2, h, w, 2))
    for r in matching.fields(done).collect():
        got[r["pair_id"], r["layer"], r["y"], r["x"]] = r["vx"], r["vy"]
    sweeps = {(r["pair_id"], r["layer"], r["level"]): r for r in matching.schedule(done).collect()}
    for k, (a, b) in enumerate(pairs):
        for layer, own in enumerate(told.layers):
            s = matching.Settings(own.w_ssim, own.w_tps, own.w_ui, own.ssim_clamp, own.max_iter, own.drop, own.eps, own.start_res, own.boundary, own.points)
            field, log = matching.morph(a[None], b[None], s, (m0[None], m1[None]) if layer else None)
            assert np.allclose(field[0], got[k, layer], atol=1e-9)
            for level, high, wide, n, *_ in log:
                r = sweeps[k, layer, level]
                assert (r["high"], r["wide"], r["sweeps"]) == (high, wide, n) and r["ms"] > 0
    assert not np.allclose(got[:, 0], got[:, 1])
    assert seen.get["jobs"] == 4 and seen.get["sweeps"] == sum(r["sweeps"] for r in sweeps.values()) and seen.get["ms"] > 0
    done.unpersist()


def crossed(field):
    """Whether cells of either warped grid are turned over."""
    y, x = np.mgrid[: field.shape[0], : field.shape[1]]
    for sign in (-1, 1):
        px, py = x + sign * field[..., 0], y + sign * field[..., 1]
        area = (px[:-1, 1:] - px[:-1, :-1]) * (py[1:, :-1] - py[:-1, :-1]) - (py[:-1, 1:] - py[:-1, :-1]) * (px[1:, :-1] - px[:-1, :-1])
        if (area < -1e-6).any():
            return True
    return False


def test_windows_of_one_image(spark):
    """One image over many tasks: its energy is that of the matcher within one in a hundred, and nothing folds over."""
    h, w, s = 33, 31, matching.Settings(w_tps=0.002)
    a, b = scene(0, h, w), scene(1.5, h, w)
    rows = [(7, y, x, float(a[y, x]), float(b[y, x]), 0.0, 0.0) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "pair_id long, y int, x int, v0 double, v1 double, vx double, vy double").repartition(4)
    made = tiled_matching.improved(df.select("pair_id", "y", "x", "vx", "vy"), df.select("pair_id", "y", "x", "v0", "v1"), (h, w), s, 3, 14, 16)
    field = np.zeros((h, w, 2))
    seen = 0
    for r in made.collect():
        field[r["y"], r["x"]] = r["vx"], r["vy"]
        seen += 1
    assert seen == h * w and not crossed(field)
    whole = matching.Level(a[None], b[None], np.zeros((1, h, w, 2)), s)
    start = whole.energies()[0]
    whole.run(12)
    tiled = matching.Level(a[None], b[None], field[None], s).energies()[0]
    assert tiled <= whole.energies()[0] + 0.01 * start and tiled < 0.5 * start
    windows = [len(list(tiled_matching._spans(0, n, n, 0, 14))) for n in (h, w)]
    assert windows[0] * windows[1] > 1  # more tasks than images


def test_windows_reach_every_pixel_and_keep_apart():
    for n, side in ((42, 14), (300, 16), (9, 256)):
        seen = np.zeros(n, bool)
        for shift in (0, (side + tiled_matching.GAP) // 2):
            spans = sorted({s[1:] for k in range(0, n, 16) for s in tiled_matching._spans(k, min(n, k + 16), n, shift, side)})
            assert all(b[0] - a[1] >= 4 for a, b in zip(spans, spans[1:]))
            for a, b in spans:
                seen[a:b] = True
        assert seen.all()


def slow_frame(i0, i1, v, u, t):
    """A frame by its definition, pixel by pixel."""
    h, w = i0.shape

    def cubic(image, y, x):
        total = weights = 0.0
        for a in range(int(np.floor(y)) - 1, int(np.floor(y)) + 3):
            for b in range(int(np.floor(x)) - 1, int(np.floor(x)) + 3):
                share = 1.0
                for d in (abs(y - a), abs(x - b)):
                    share *= 1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0
                total, weights = total + share * image[min(max(a, 0), h - 1), min(max(b, 0), w - 1)], weights + share
        return total / weights

    smooth = lambda low, high: (lambda z: z * z * (3 - 2 * z))(min(max((t - low) / (high - low), 0), 1))
    s, c, out = smooth(0, 1), smooth(0.2, 0.8), np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            now = np.concatenate([v[y, x], u[y, x]])
            for _ in range(20):
                p = np.array([x, y]) - (2 * s - 1) * now[:2] - (4 * s - 4 * s * s) * now[2:]
                now = 0.2 * now + 0.8 * np.array([cubic(f[..., k], p[1], p[0]) for f in (v, u) for k in (0, 1)])
            one, two = cubic(i0, p[1] - now[1], p[0] - now[0]), cubic(i1, p[1] + now[1], p[0] + now[0])
            out[y, x] = one * (1 - c) + two * c
    return out


def test_morph_frame_by_definition(spark, tmp_path):
    few = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 4")
    few.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = np.zeros((2, 4, 8, 8))
    for r in catalog.QUERIES["morph_frame"](spark, str(tmp_path)).collect():
        got[r["pair_id"], r["frame"], r["y"], r["x"]] = r["v"]
    vectors = {r["vec_id"]: (np.array(r["embedding"], float).reshape(8, 8) + 1) * 127.5 for r in few.collect()}
    y, x = np.mgrid[:8, :8]
    v = np.stack([((3 * x + 5 * y) % 7 - 3) / 4, ((5 * x + 3 * y) % 7 - 3) / 4], -1)
    for k in range(2):
        for n, t in enumerate((0.0, 0.25, 0.5, 1.0)):
            assert np.allclose(got[k, n], slow_frame(vectors[2 * k], vectors[2 * k + 1], v, v / 4, t), atol=2e-3)
    assert render.frame_schedule(1, 5) == [49, 50, 51, 50, 49]


def test_trial_moves_are_looked_at_by_blocks(monkeypatch):
    """However many jobs go side by side, trial moves take arrays of a bounded size, with the same fields."""
    images = np.random.default_rng(3).uniform(0, 255, (2, 12, 8, 8))
    settings = matching.Settings(start_res=4, max_iter=4)
    whole, _ = matching.morph(*images, settings)
    sizes, plain = [], matching.Level._change
    monkeypatch.setattr(matching, "BLOCK", 7)
    monkeypatch.setattr(matching.Level, "_change", lambda self, b, *rest: sizes.append(len(b)) or plain(self, b, *rest))
    parted, _ = matching.morph(*images, settings)
    assert max(sizes) == 7
    np.testing.assert_allclose(parted, whole, atol=1e-9)


def test_costs_by_one_division_and_places_beyond_the_frame():
    rng = np.random.default_rng(4)
    m, p, q = rng.uniform(0, 1, (25, 300)), rng.uniform(0, 255, (25, 300)), rng.uniform(0, 255, (25, 300))
    m[:, :40] *= 0.03  # less than a pixel: no cost
    n, s0, s1, q0, q1, c = (t.sum(0) for t in (m, m * p, m * q, m * p * p, m * q * q, m * p * q))
    v0, v1, cov = q0 / n - (s0 / n) ** 2, q1 / n - (s1 / n) ** 2, c / n - s0 * s1 / n**2
    dev, c2 = np.sqrt(v0 * v1), 58.5225
    cost = 1 - (2 * dev + c2) / (v0 + v1 + c2) * (np.abs(cov) + c2 / 2) / (dev + c2 / 2)
    np.testing.assert_allclose(matching._ssim(n, s0, s1, q0, q1, c, 0.1), np.where(n <= 1, 0, np.clip(cost, 0, 0.9)), atol=1e-9)
    image = rng.uniform(0, 255, (1, 3, 4))
    y, x = np.array([-9.5, -2.0, -0.5, 1.25, 2.5, 3.0, 40.0]), np.array([1.5, -7.25, 0.0, 3.5, 2.25, 3.75, -30.0])
    values, masks = matching.Masked(image, None).at(np.zeros(7, int), y, x)
    np.testing.assert_allclose(values, matching.bilinear(image, np.zeros(7, int), y, x), atol=1e-9)
    np.testing.assert_allclose(masks, 255 * (1 - matching.bilinear(np.pad(np.ones((1, 3, 4)), ((0, 0), (2, 2), (2, 2))), np.zeros(7, int), y + 2, x + 2)), atol=1e-9)
