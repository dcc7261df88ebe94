"""Scans of a site fitted together, against known poses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import placing as P


def solid(yaw, shift):
    a = np.radians(yaw)
    m = np.eye(4)
    m[:2, :2] = [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]
    m[:3, 3] = shift
    return m


def apply(m, p):
    return p @ m[:3, :3].T + m[:3, 3]


@pytest.fixture(scope="module")
def street():
    rng = np.random.default_rng(7)
    box = lambda x, y, w, h, n: np.column_stack([rng.uniform(x, x + w, n), rng.uniform(y, y + w, n), rng.uniform(0, h, n)])
    ground = np.column_stack([rng.uniform(0, 24, (15000, 1)), rng.uniform(6, 16, (15000, 1)), rng.normal(0, 0.005, (15000, 1))])
    wall = np.column_stack([rng.uniform(0, 24, 9000), rng.normal(13, 0.005, 9000), rng.uniform(0, 2.4, 9000)])
    sides = [np.column_stack([rng.normal(x, 0.005, 2500), rng.uniform(13, 16, 2500), rng.uniform(0, 2.4, 2500)]) for x in (4, 11, 19)]
    return np.concatenate([ground, wall, *sides, box(7, 8, 0.5, 1.2, 900), box(12.5, 9, 0.4, 1.6, 900), box(15, 7, 0.7, 0.9, 900), box(9.5, 10.5, 0.3, 1.9, 700)])


def test_matrices(spark):
    a, b = solid(30, [1, 2, 3]), solid(-50, [4, 0, 1])
    row = spark.range(1).select(P.times(P.pose(a.ravel()), P.pose(b.ravel())).alias("t"), P.inverse(P.pose(a.ravel())).alias("i"), P.heading(P.pose(a.ravel())).alias("h"), P.tilt(P.pose(a.ravel())).alias("k")).first()
    assert np.allclose(row.t, (a @ b).ravel()) and np.allclose(row.i, np.linalg.inv(a).ravel()) and round(row.h, 6) == 30 and row.k == 0


def test_three_scans_with_known_poses(spark, street):
    poses = {"a": solid(0, [0, 0, 0]), "b": solid(3.0, [0.5, -0.4, 0.06]), "c": solid(-2.0, [-0.4, 0.5, -0.05])}
    rng = np.random.default_rng(8)
    rows = []
    for name, (lo, hi) in {"a": (0, 16), "b": (6, 20), "c": (8, 24)}.items():
        own = street[(street[:, 0] >= lo) & (street[:, 0] <= hi)]
        own = own[rng.random(len(own)) < (1.0 if name == "a" else 0.8)]
        rows += [(name, k, *map(float, p)) for k, p in enumerate(apply(np.linalg.inv(poses[name]), own))]
    far = street[:800] + [200, 0, 0]
    rows += [("d", k, *map(float, p)) for k, p in enumerate(far)]
    points = spark.createDataFrame(rows, "scan string, pid long, x double, y double, z double")
    scans = spark.createDataFrame([(s, 1) for s in "abcd"], "scan string, site int")
    placed = P.registered(points, scans, [-2.5, 0.0, 2.5], voxel=0.2, cell=0.25, tries=2, most_shift=3.0)
    found = {r.scan: r for r in placed.collect()}
    assert {s: r.status for s, r in found.items()} == {"a": "anchor", "b": "registered", "c": "registered", "d": "unmatched"}
    assert {s: r.placed_by for s, r in found.items()} == {"a": None, "b": "scans", "c": "scans", "d": None}
    for name in "bc":
        got, want = np.array(found[name].transform).reshape(4, 4), poses[name]
        raw = apply(np.linalg.inv(want), street[(street[:, 0] > 9) & (street[:, 0] < 15)])
        assert np.linalg.norm(apply(got, raw) - apply(want, raw), axis=1).mean() < 0.05
    cloud = P.stitched(points, scans, placed)
    assert cloud.count() == len(rows) and cloud.where("scan = 'd'").agg(F.min("x")).first()[0] > 190


def test_scans_level_without_a_fit(spark):
    x, y = np.meshgrid(np.arange(0.25, 5, 0.5), np.arange(0.25, 5, 0.5))
    rows = [(s, k, float(a), float(b), z) for s, z in (("a", 0.0), ("b", 1.5), ("c", -2.0)) for k, (a, b) in enumerate(zip(x.ravel(), y.ravel(), strict=True))]
    rows += [("e", 0, 0.25, 0.25, 9.0)]
    points = spark.createDataFrame(rows, "scan string, pid long, x double, y double, z double")
    scans = spark.createDataFrame([(s, 1) for s in "abce"], "scan string, site int")
    top = {r.scan: r.z for r in P.stitched(points, scans, None).groupBy("scan").agg(F.max("z").alias("z")).collect()}
    assert top == {"a": 0.0, "b": 0.0, "c": 0.0, "e": 9.0}
    assert P.stitched(points.limit(0), scans, None).count() == 0


def scan_rows(name, cloud):
    return [(name, k, *map(float, p)) for k, p in enumerate(cloud)]


def test_group_and_single_scans_are_joined_nearest_first(spark):
    between = spark.createDataFrame([(1, "a", "b", 2.0), (1, "b", "c", 1.0), (1, "c", "d", 3.0), (1, "d", "e", 2.5), (2, "f", "g", 9.0)], "site int, a string, b string, distance double")
    assert {(r.site, r.a, r.b) for r in P._nearest_groups(between).collect()} == {(1, "b", "c"), (1, "d", "e"), (2, "f", "g")}


def test_a_scan_that_only_two_others_together_hold(spark, street):
    """c shares with a and with b less than an eighth of its cells, too little for either alone; fitted to the group of both, it joins."""
    rng = np.random.default_rng(9)
    x, y = street[:, 0], street[:, 1]
    parts = {"a": (x < 13) & (y < 10.5) | (x < 8), "b": (x > 3) & (x < 13) & (y >= 10.5), "c": x > 11}
    pose_c = solid(1.0, [0.3, -0.2, 0.02])
    about = solid(0, [17.5, 11, 0]) @ pose_c @ solid(0, [-17.5, -11, 0])
    rows = []
    for name, own in parts.items():
        cloud = street[own]
        cloud = cloud[rng.random(len(cloud)) < {"a": 0.95, "b": 0.95, "c": 0.55}[name]]
        rows += scan_rows(name, apply(np.linalg.inv(about), cloud) if name == "c" else cloud)
    points = spark.createDataFrame(rows, "scan string, pid long, x double, y double, z double")
    scans = spark.createDataFrame([(s, 1) for s in "abc"], "scan string, site int")
    rules = {"voxel": 0.15, "cell": 0.25, "tries": 2, "most_shift": 0.6}
    for alone in ("a", "b"):
        two = P.joined(points.where(F.col("scan").isin(alone, "c")), scans, [0.0], **rules)
        assert two.select("group").distinct().count() == 2, alone
    state = {r.scan: r for r in P.joined(points, scans, [0.0], **rules).collect()}
    assert len({r.group for r in state.values()}) == 1
    true = {"a": np.eye(4), "b": np.eye(4), "c": about}
    root = next(r.scan for r in state.values() if r.anchor)
    for name, r in state.items():
        want = np.linalg.inv(true[root]) @ true[name]
        own = apply(np.linalg.inv(true[name]), street[(x > 9) & (x < 15)])
        assert np.linalg.norm(apply(np.array(r.transform).reshape(4, 4), own) - apply(want, own), axis=1).mean() < 0.08, name


def house_fronts(rng, xs, n=700):
    """Ground of a street along x and house fronts (start, end, y) with side walls at both ends."""
    parts = []
    for lo, hi, y in xs:
        parts += [np.column_stack([rng.uniform(lo, hi, 2 * n), rng.normal(y, 0.01, 2 * n), rng.uniform(0, 2.4, 2 * n)])]
        parts += [np.column_stack([rng.normal(e, 0.01, n), rng.uniform(y, y + 3, n), rng.uniform(0, 2.4, n)]) for e in (lo, hi)]
    return np.concatenate(parts)


def ground(rng, lo, hi, n=6000):
    return np.column_stack([rng.uniform(lo, hi, n), rng.uniform(0, 14, n), rng.normal(0, 0.004, n)])


def fronts_on_the_map(xs):
    line = lambda a, b: np.column_stack([np.linspace(a[0], b[0], 60), np.linspace(a[1], b[1], 60)])
    return np.concatenate([line(a, b) for lo, hi, y in xs for a, b in (((lo, y), (hi, y)), ((lo, y), (lo, y + 3)), ((hi, y), (hi, y + 3)))])


def test_groups_that_only_the_map_joins(spark):
    """Two scans that share a bare strip of ground: the map places each, and their poses agree there."""
    rng = np.random.default_rng(21)
    west, east = [(1, 5, 8), (7, 11, 9.5)], [(17, 21, 8.5), (23.5, 28, 10)]
    a = np.concatenate([ground(rng, 0, 16), house_fronts(rng, west)])
    b = np.concatenate([ground(rng, 12.5, 29), house_fronts(rng, east)])
    off = solid(3.0, [1.2, -0.8, 0.0])
    points = spark.createDataFrame(scan_rows("a", a) + scan_rows("b", apply(np.linalg.inv(off), b)), "scan string, pid long, x double, y double, z double")
    scans = spark.createDataFrame([("a", 1), ("b", 1)], "scan string, site int")
    mapped = spark.createDataFrame([(1, "wall", *map(float, p)) for p in fronts_on_the_map(west + east)], "site int, kind string, x double, y double")
    rules = {"voxel": 0.15, "cell": 0.25, "tries": 2, "most_shift": 3.0}
    alone = P.joined(points, scans, [0.0], **rules)
    assert alone.select("group").distinct().count() == 2
    state = {r.scan: r for r in P.joined(points, scans, [0.0], mapped=mapped, **rules).collect()}
    moved = next(r for r in state.values() if r.placed_by)
    assert moved.placed_by == "map" and len({r.group for r in state.values()}) == 1
    got = np.array(moved.transform).reshape(4, 4) if moved.scan == "b" else np.linalg.inv(np.array(moved.transform).reshape(4, 4))
    assert np.linalg.norm(apply(got, apply(np.linalg.inv(off), b)) - b, axis=1).mean() < 0.4


def test_the_map_picks_the_second_hypothesis(spark):
    """Two fits of one pair that the scans don't tell apart; only the second lies on the map."""
    rng = np.random.default_rng(22)
    fronts = [(1, 5, 8), (7, 12, 9.5)]
    one = np.concatenate([ground(rng, 0, 14), house_fronts(rng, fronts)])
    cloud = spark.createDataFrame(scan_rows("f", one) + scan_rows("m", one[::2]), "scan string, pid long, x double, y double, z double")
    wrong, right = solid(0.0, [4.0, 0.0, 0.0]), solid(0.0, [0.0, 0.0, 0.0])
    tied = spark.createDataFrame([(1, "f", "m", 1, wrong.ravel().tolist()), (1, "f", "m", 2, right.ravel().tolist())], "site int, fixed string, moving string, rank int, transform array<double>")
    mapped = spark.createDataFrame([(1, "wall", *map(float, p)) for p in fronts_on_the_map(fronts)], "site int, kind string, x double, y double")
    assert [(r.fixed, r.moving, r["rank"]) for r in P._map_choice(cloud, tied, mapped).collect()] == [("f", "m", 2)]


def test_map_pose(spark):
    row = spark.createDataFrame([(10.0, 3.0, -2.0, 5.0, 7.0)], "degrees double, dx double, dy double, cx double, cy double").select(P.map_pose().alias("m")).first()
    m = np.array(row.m).reshape(4, 4)
    assert np.allclose(m @ [5, 7, 1, 1], [8, 5, 1, 1]) and np.isclose(np.degrees(np.arctan2(m[1, 0], m[0, 0])), 10)


def test_neighbours_by_cells(spark):
    rng = np.random.default_rng(23)
    centres = rng.uniform(-100, 100, (60, 2))
    rows = [(f"s{k}", j, *map(float, c), 0.0) for k, c in enumerate(centres) for j in range(1 + k % 3)]
    points = spark.createDataFrame(rows, "scan string, pid long, x double, y double, z double")
    scans = spark.createDataFrame([(f"s{k}", k % 2) for k in range(60)], "scan string, site int")
    got = {frozenset((r.fixed, r.moving)) for r in P.neighbouring(points, scans, 40.0).collect()}
    assert got == {frozenset((f"s{i}", f"s{j}")) for i in range(60) for j in range(i) if i % 2 == j % 2 and np.hypot(*(centres[i] - centres[j])) <= 40}


def test_site_scans_by_rung(spark, tmp_path):
    """LAS and PLY files in, a LAS file per site and a report out: each rung has a site."""
    from sluice.sources import clouds

    rng = np.random.default_rng(31)
    fronts = [(1, 5, 8), (7, 11, 9.5), (12.5, 15, 8.5)]
    whole = np.concatenate([ground(rng, 0, 16, 9000), house_fronts(rng, fronts, 500)])
    off, true = solid(2.0, [0.6, -0.4, 0.03]), solid(4.0, [1.5, 1.0, 0.0])
    one, two = whole[whole[:, 0] < 13], apply(np.linalg.inv(off), whole[whole[:, 0] > 4][::2])
    flat = np.column_stack([rng.uniform(0, 5, (400, 2)), np.zeros(400)])
    for name, cloud in {"fit-1": one, "fit-2": two, "lone-1": flat, "far-1": flat, "far-2": flat + [300, 0, 2.0]}.items():
        (tmp_path / f"{name}.las").write_bytes(clouds.las_bytes(cloud, np.full((len(cloud), 3), 90)))
    for name in ("ply-1", "ply-2", "mix-2"):
        lines = [f"{a} {b} {c} 9 9 9" for a, b, c in flat[:20].round(3)]
        head = "ply\nformat ascii 1.0\nelement vertex 20\n" + "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"
        (tmp_path / f"{name}.ply").write_text(head + "\n".join(lines) + "\n")
    (tmp_path / "mix-1.las").write_bytes(clouds.las_bytes(flat, np.full((len(flat), 3), 90)))
    points = clouds.points(spark, str(tmp_path))
    names = {"fit-1": "las", "fit-2": "las", "lone-1": "las", "far-1": "las", "far-2": "las", "ply-1": "ply", "ply-2": "ply", "mix-1": "las", "mix-2": "ply"}
    scans = spark.createDataFrame([(n, n[:-2], k) for n, k in names.items()], "scan string, site string, kind string")
    mapped = spark.createDataFrame([("fit", "wall", *map(float, apply(true, np.append(p, 0))[:2])) for p in fronts_on_the_map(fronts)], "site string, kind string, x double, y double")
    cloud, report = P.site_scan(points, scans, [0.0], mapped, voxel=0.15, cell=0.25, tries=2, most_shift=2.0)
    rows = {r.scan: r for r in report.collect()}
    assert {n: r.rung for n, r in rows.items()} == {"fit-1": "registered", "fit-2": "registered", "lone-1": "single", "far-1": "rough positions", "far-2": "rough positions", "ply-1": "as they are", "ply-2": "as they are", "mix-1": "refused", "mix-2": "refused"}
    assert {rows["fit-1"].status, rows["fit-2"].status} == {"anchor", "registered"} and rows["fit-1"].applied and rows["fit-1"].walls > 0.6
    got = np.array(rows["fit-2"].transform).reshape(4, 4)
    assert np.linalg.norm(apply(got, two) - apply(true @ off, two), axis=1).mean() < 0.3
    files = {r.scan: clouds.las_header(bytes(r.content)) for r in P.site_files(cloud).collect()}
    assert {n: h["n"] for n, h in files.items()} == {"fit": len(one) + len(two), "lone": 400, "far": 800, "ply": 40}
    assert {r.scan: round(r.z, 3) for r in cloud.where("site = 'far'").groupBy("scan").agg(F.avg("z").alias("z")).collect()} == {"far-1": 0.0, "far-2": 2.0}
