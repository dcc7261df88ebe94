"""Numeric kernels against synthetic truth."""

import numpy as np
import pytest

from sluice.operators import registration as R


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(3)
    ground = np.column_stack([rng.uniform(0, 20, (6000, 2)), rng.normal(0, 0.01, 6000)])
    wall = np.column_stack([rng.uniform(0, 20, 2500), rng.normal(12, 0.01, 2500), rng.uniform(0, 2.4, 2500)])
    side = np.column_stack([rng.normal(5, 0.01, 1500), rng.uniform(12, 18, 1500), rng.uniform(0, 2.4, 1500)])
    box = np.column_stack([rng.uniform(14, 15, (800, 2)), rng.uniform(0, 1.2, 800)])
    return np.concatenate([ground, wall, side, box])


def test_nearest_is_brute_force():
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 3, (200, 3)), rng.uniform(0, 3, (300, 3))
    d, at = R.nearest(a, b, 0.5, 3)
    full = np.linalg.norm(a[:, None] - b[None], axis=2)
    for i in range(200):
        want = [k for k in np.argsort(full[i])[:3] if full[i, k] <= 0.5]
        assert [k for k in at[i] if k >= 0] == want


def test_normals(scene):
    n = R.normals(scene[:3000], 10, 0.6)
    assert np.nanmedian(n[:, 2]) > 0.99


def test_icp_recovers_pose(scene):
    a = np.radians(2.0)
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    moving = (scene[::2] - [0.3, -0.2, 0.05]) @ r
    pose, rms, share = R.icp(scene, moving, dof=4, reach=(1.0, 0.2))
    back = moving @ pose[:3, :3].T + pose[:3, 3]
    assert np.linalg.norm(back - scene[::2], axis=1).mean() < 0.03 and rms < 0.05 and share > 0.9


def best_shift(one, two, cell, bright=(None, None)):
    """(dx, dy, score) that brings `two` onto `one` by the best agreement."""
    a, b = R.rasters(one, bright[0], cell), R.rasters(two, bright[1], cell)
    score, _ = R.agreement(a, b, 8 / cell**2)
    i, j, s = R.peaks(score, 1, 8)[0]
    return a.origin[0] - b.origin[0] + (j - b.seen.shape[1] + 1) * cell, a.origin[1] - b.origin[1] + (i - b.seen.shape[0] + 1) * cell, s


def test_coarse_shift(scene):
    dx, dy, s = best_shift(scene, scene + [3.0, -1.5, 0], 0.25)
    assert abs(dx + 3.0) <= 0.5 and abs(dy - 1.5) <= 0.5 and s > 0.9


def wall_with_bays(rng, length, bays):
    """A wall along x with ground before it and bays (start, width) that stand out."""
    ground = np.column_stack([rng.uniform(0, length, 9000), rng.uniform(0, 8, 9000), rng.normal(0, 0.004, 9000)])
    wall = np.column_stack([rng.uniform(0, length, 6000), rng.normal(8, 0.01, 6000), rng.uniform(0, 2.4, 6000)])
    parts = [np.column_stack([rng.uniform(x, x + w, 900), rng.uniform(7, 8, 900), rng.uniform(0, 2.4, 900)]) for x, w in bays]
    return np.concatenate([ground, wall, *parts])


def test_self_similar_wall_is_matched_where_it_overlaps():
    """Equal bays every 4 m but where the scans overlap: the wall alone makes a plain sum take the largest overlap."""
    rng = np.random.default_rng(11)
    bays = [(x, 1.0) for x in (2, 6, 10, 26, 30, 34)] + [(13, 0.6), (15.2, 2.0), (20.5, 1.4)]
    whole = wall_with_bays(rng, 40, bays)
    one, two = whole[whole[:, 0] < 24], whole[(whole[:, 0] > 12)]
    moved = two + [5.0, 1.0, 0.0]
    dx, dy, _ = best_shift(one, moved, 0.2)
    assert abs(dx + 5.0) <= 0.4 and abs(dy + 1.0) <= 0.4
    a, b = R.rasters(one, None, 0.2), R.rasters(moved, None, 0.2)
    shape = tuple(m + n - 1 for m, n in zip(a.seen.shape, b.seen.shape, strict=True))
    plain = np.fft.irfft2(sum(np.fft.rfft2(p, shape) * np.fft.rfft2(q[::-1, ::-1], shape) for p, q in zip(a.channels, b.channels, strict=True)), shape)
    i, j, _ = R.peaks(plain, 1, 8)[0]
    assert abs(a.origin[0] - b.origin[0] + (j - b.seen.shape[1] + 1) * 0.2 + 5.0) > 1  # the plain sum takes another bay


def test_paint_fixes_a_featureless_street():
    """Flat ground: only marks on it tell the place."""
    rng = np.random.default_rng(12)
    xy = rng.uniform(0, 24, (30000, 2))
    mark = ((np.abs(xy[:, 0] - 9) < 0.3) | (np.abs(xy[:, 1] - 14) < 0.3) & (xy[:, 0] < 16) | (np.hypot(xy[:, 0] - 17, xy[:, 1] - 6) < 1)).astype(float)
    flat = np.column_stack([xy, np.zeros(len(xy))])
    a, b = xy[:, 0] < 20, xy[:, 0] > 4
    dx, dy, s = best_shift(flat[a], flat[b] + [1.6, -2.2, 0], 0.2, (mark[a], mark[b]))
    assert abs(dx + 1.6) <= 0.3 and abs(dy - 2.2) <= 0.3 and s > 0.5


def test_finer_search(scene):
    yaw, dx, dy = R.finer(scene, R.turn(scene, 3.0) + [1.3, -0.9, 0], (-2.0, -1.5, 0.5))
    back = R.turn(R.turn(scene, 3.0) + [1.3, -0.9, 0], yaw) + [dx, dy, 0]
    assert np.linalg.norm(back - scene, axis=1).mean() < 0.3
    assert R.finer(scene, scene + [500.0, 0, 0], (1.0, 2.0, 3.0)) == (1.0, 2.0, 3.0)


def test_distance_transform_and_labels():
    rng = np.random.default_rng(1)
    mask = rng.random((17, 23)) < 0.1
    mask[3, 4] = True
    at = np.argwhere(mask)
    want = np.sqrt(((np.indices(mask.shape).transpose(1, 2, 0)[:, :, None] - at) ** 2).sum(axis=3).min(axis=2))
    assert np.allclose(R.distance_transform(mask), want)
    m = np.zeros((5, 6), bool)
    m[0, 0] = m[1, 1] = m[4, 4] = m[4, 5] = True
    lab = R.label(m)
    assert lab[0, 0] == lab[1, 1] != lab[4, 4] == lab[4, 5] and R.label(m, diagonal=False)[0, 0] != R.label(m, diagonal=False)[1, 1]


def test_rigid_and_ransac():
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 20, (80, 2))
    t = np.radians(12)
    r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    b = a @ r.T + [4, -3]
    b[:30] = rng.uniform(0, 20, (30, 2))
    got, shift, n = R.ransac_2d(a, b)
    assert n >= 50 and np.allclose(got, r, atol=1e-6) and np.allclose(shift, [4, -3], atol=1e-6)


def test_map_starts():
    line = np.concatenate([np.column_stack([np.arange(0, 30, 0.25), np.zeros(120)]), np.column_stack([np.zeros(60), np.arange(0, 15, 0.25)])])
    starts = R.map_starts([(line[::3] + [2.0, 1.0], line, 1.0, 0.45), (np.zeros((0, 2)), line, 0.5, 1.2)], most_shift=6, most_yaw=6)
    dx, dy, yaw = starts[0]
    assert (abs(dx + 2) <= 0.5, abs(dy + 1) <= 0.5, abs(yaw) <= 1) == (True, True, True) and len(starts) <= 6
    assert R.map_starts([(np.zeros((0, 2)), line, 1.0, 0.45)]) == []


def test_tiles_give_whole_scan_normals(spark, scene):
    some = scene[::5]
    df = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(some)], "scan int, pid long, x double, y double, z double")
    out = R.with_normals(df, 8, 0.8, 6.0).orderBy("pid").toPandas()
    want = R.normals(some, 8, 0.8)
    assert len(out) == len(some) and np.allclose(out[["nx", "ny", "nz"]].to_numpy(), want, atol=1e-6, equal_nan=True)


def test_all_neighbouring_scans_are_registered(spark, sf):
    from sluice.plans import clouds, tables

    scans = {r.scan for r in tables.points(spark, sf).select("scan").distinct().collect()}
    want = {(k, k + 1) for k in scans if k + 1 in scans}
    assert len(want) > 3
    for query in (clouds.coarse_registration, clouds.refined_registration):
        assert {(r.fixed, r.moving) for r in query(spark, sf).select("fixed", "moving").collect()} == want


def test_lines_along_step_edges(spark):
    from sluice.operators import scene

    rng = np.random.default_rng(5)
    kerb, other = np.column_stack([np.full(600, 40), np.arange(600)]), np.column_stack([70 + np.arange(400) // 10, np.arange(400)])
    noise = rng.integers(0, 600, (60, 2))
    df = spark.createDataFrame([("a", *map(int, p)) for p in np.concatenate([kerb, other, noise])], "scan string, cx long, cy long")
    lines = scene.edge_lines(df, 0.05, draws=400).orderBy("line").collect()
    assert [round(r.angle) for r in lines] == [90, 84] and abs(lines[0].x - 2.025) < 0.02 and lines[0].points >= 600


def test_step_edges_find_a_kerb(spark):
    from sluice.operators import scene

    x, y = np.meshgrid(np.arange(0, 2, 0.025), np.arange(0, 2, 0.025))
    df = spark.createDataFrame([("a", k, float(a) + 0.01, float(b) + 0.01, 0.12 if a >= 1 else 0.0) for k, (a, b) in enumerate(zip(x.ravel(), y.ravel(), strict=True))], "scan string, pid long, x double, y double, z double")
    rows = scene.step_edges(df).collect()
    assert rows and {r.cx for r in rows} <= {18, 19, 20, 21} and len({r.cy for r in rows}) > 25


def test_site_on_the_map(spark):
    """The known pose is found from 15 m and 20 degrees away, without starting poses."""
    front = np.concatenate([np.column_stack([np.arange(0, 30, 0.1), np.zeros(300)]), np.column_stack([np.zeros(150), np.arange(0, 15, 0.1)]), np.column_stack([np.full(60, 21.0), np.arange(-6, 0, 0.1)])])
    trees = np.array([[4.0, 5.0], [9.0, 6.5], [17.0, 5.2], [23.0, 7.0]])
    t = np.radians(20.0)
    r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    centre = np.concatenate([front, trees]).mean(axis=0)
    away = lambda p: (p - centre) @ r.T + centre + [12.0, -9.0]
    rows = [(1, kind, *map(float, p), False) for kind, points in (("wall", front), ("pole", trees), ("kerb", front + [0.0, 2.0])) for p in points]
    rows += [(1, kind, *map(float, p), True) for kind, points in (("wall", away(front[::2])), ("pole", away(trees)), ("kerb", away(front[::5] + [0.0, 2.0]))) for p in points]
    rows += [(2, "wall", 1.0, 1.0, True), (2, "wall", 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "site int, kind string, x double, y double, own boolean")
    out = {r.site: r for r in R.placed_on_map(df.where("own"), df.where("not own")).collect()}
    assert out[1].applied and abs(out[1].degrees + 20.0) < 0.3 and out[1].walls > 0.95 and out[1].poles == 1.0 and out[1].kerbs > 0.95 and out[1].mean_m < 0.05
    assert abs(np.hypot(out[1].dx, out[1].dy) - 15) < 1
    assert not out[2].applied and out[2].why == "too little to match" and out[2].score is None
