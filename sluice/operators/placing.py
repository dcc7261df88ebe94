"""Scans of a site fitted to each other: hypotheses of pairs, groups joined nearest first, joint refinement, levelled merging, and the map's part.

Points are scan, pid, x, y, z in a local frame (metres, rough positions and headings); scans are scan and site. Sites are
independent, so every step runs over all sites at once. What meets in one task is a pair of voxel samples of bounded
size: of groups of scans, or of a scan and what its neighbours have around it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.recovery import cut
from . import fits, grid, measure, registration, scene

IDENTITY = [1.0 if k % 5 == 0 else 0.0 for k in range(16)]


def pose(values: list[float] | np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def times(a: Column, b: Column) -> Column:
    """Product of row-major 4 x 4 matrices (arrays of 16)."""
    return F.array(*[sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)])


def inverse(m: Column) -> Column:
    """Of a rigid motion."""
    rows = []
    for i in range(3):
        turned = [m[4 * k + i] for k in range(3)]
        rows += [*turned, -(turned[0] * m[3] + turned[1] * m[7] + turned[2] * m[11])]
    return F.array(*rows, *[F.lit(float(v)) for v in (0, 0, 0, 1)])


def heading(m: Column) -> Column:
    """Degrees turned about the vertical."""
    return F.degrees(F.atan2(m[4], m[0]))


def tilt(m: Column) -> Column:
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), m[10]))))


def moved(points: DataFrame, matrix: Column) -> DataFrame:
    """Points under a matrix of their own row."""
    return points.withColumns({c: matrix[4 * k] * F.col("x") + matrix[4 * k + 1] * F.col("y") + matrix[4 * k + 2] * F.col("z") + matrix[4 * k + 3] for k, c in enumerate("xyz")})


def bright(points: DataFrame) -> DataFrame:
    """scan, pid, x, y, z and the brightness b (0 to 1) of points with colours r, g, b; null without colours."""
    lit = (F.col("r") + F.col("g") + F.col("b")) / (3 * 255.0) if {"r", "g", "b"} <= set(points.columns) else F.col("b") if "b" in points.columns else F.lit(None)
    return points.select("scan", "pid", "x", "y", "z", lit.cast("double").alias("b"))


def neighbouring(points: DataFrame, scans: DataFrame, reach: float) -> DataFrame:
    """site, fixed, moving and distance of scans of a site whose centres lie within reach; the one with more points is fixed (the lesser name among equals).

    Centres are filed by cells of the reach, so that a site of many scans isn't paired with itself.
    """
    centre = points.groupBy("scan").agg(F.avg("x").alias("px"), F.avg("y").alias("py"), F.count("*").alias("n"))
    s = cut(scans.select("scan", "site").join(centre, "scan").withColumns({"cx": F.floor(F.col("px") / reach), "cy": F.floor(F.col("py") / reach)}))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = s.withColumn("_a", F.explode(around)).select("site", (F.col("cx") + F.col("_a.i")).alias("cx"), (F.col("cy") + F.col("_a.j")).alias("cy"), *[F.col(c).alias(f"_{c}") for c in ("scan", "px", "py", "n")])
    first = (F.col("n") > F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("scan") < F.col("_scan")))
    distance = F.hypot(F.col("px") - F.col("_px"), F.col("py") - F.col("_py"))
    return s.join(b, ["site", "cx", "cy"]).where(first).withColumn("distance", distance).where(F.col("distance") <= reach).select("site", F.col("scan").alias("fixed"), F.col("_scan").alias("moving"), "distance")


def evaluated(sample: DataFrame, poses: DataFrame, cell: float = 0.2) -> DataFrame:
    """Fits of pairs from starting poses (fixed, moving, yaw, dx, dy), with the evidence for each, ranked within its pair (measure.evidence).

    A fit starts from the best pose on 10 cm cells near the given one. Evidence: compact objects, walls and, where points have
    a brightness b, the texture of the ground. moved and turned: from the given pose, metres at the moving centre and degrees.
    """
    fit = cut(registration.refine(sample, poses, settle=True).where(F.col("rms") < float("inf")).withColumn("pair", F.concat_ws("/", "fixed", "moving", "yaw", "dx", "dy")))
    heights = grid.height_over_ground(sample, 1.0).select("scan", "pid", "h")
    lit = sample.select("scan", "pid", (F.col("b") if "b" in sample.columns else F.lit(None).cast("double")).alias("b"))
    whole = cut(registration.with_normals(sample).join(heights, ["scan", "pid"]).join(lit, ["scan", "pid"]))
    fixed = fit.select("pair", F.col("fixed").alias("scan")).join(whole, "scan").drop("scan")
    moving = moved(fit.select("pair", F.col("moving").alias("scan"), "transform").join(whole.drop("nx", "ny", "nz"), "scan"), F.col("transform")).drop("scan", "transform")
    size = whole.groupBy("scan").agg(F.count("*").alias("_size"), F.avg("x").alias("_x"), F.avg("y").alias("_y")).withColumnRenamed("scan", "moving")
    t, x, y, a = F.col("transform"), F.col("_x"), F.col("_y"), F.radians("_yaw")
    shift = F.hypot(t[0] * x + t[1] * y + t[3] - x, t[4] * x + t[5] * y + t[7] - y)
    start = (F.cos(a) * x - F.sin(a) * y + F.col("dx"), F.sin(a) * x + F.cos(a) * y + F.col("dy"))
    off = F.hypot(t[0] * x + t[1] * y + t[3] - start[0], t[4] * x + t[5] * y + t[7] - start[1])
    turned = F.abs(F.pmod(heading(t) - F.col("_yaw") + 180, F.lit(360.0)) - 180)
    out = fit.drop("conflict").withColumnRenamed("yaw", "_yaw").join(size, "moving").withColumns({"yaw": heading(t), "shift": shift, "moved": off, "turned": turned, "near": F.col("overlap") * F.col("_size")})
    out = out.join(fits.consistency(moving, fixed, max(0.1, cell)), "pair", "left").join(fits.wall_fit(moving, fixed), "pair", "left").join(fits.ground_texture(moving, fixed), "pair", "left")
    return measure.evidence(out).drop("_size", "_x", "_y", "_yaw")


def hypotheses(sample: DataFrame, pairs: DataFrame, yaws: list[float], cell: float = 0.2, tries: int = 3, most_shift: float = 20.0) -> DataFrame:
    """Evaluated fits of pairs (fixed, moving) from their best distinct coarse poses."""
    found = registration.coarse_search(sample, pairs.select("fixed", "moving"), yaws, cell, 4, most_shift)
    return evaluated(sample, cut(registration.distinct_poses(found, tries).select("fixed", "moving", "yaw", "dx", "dy")), cell)


def map_features(points: DataFrame) -> DataFrame:
    """site (of a column scan), kind (wall, pole or kerb), x, y: what placed points show that a map may have."""
    high = cut(grid.height_over_ground(points, 1.0))
    found = cut(scene.structures(high))
    at = lambda c, size: ((F.col(c) + 0.5) * size).alias(c[1])
    walls = found.where("kind = 'wall'").select("scan", F.lit("wall").alias("kind"), at("cx", 0.15), at("cy", 0.15))
    kerbs = scene.kerbs(high).select("scan", F.lit("kerb").alias("kind"), at("cx", 0.1), at("cy", 0.1))
    return walls.unionByName(scene.poles(found).withColumn("kind", F.lit("pole"))).unionByName(kerbs).withColumnRenamed("scan", "site")


def map_pose() -> Column:
    """The motion of a placement on the map (registration.PLACED)."""
    a, cx, cy = F.radians("degrees"), F.col("cx"), F.col("cy")
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [F.cos(a), -F.sin(a), zero, cx - F.cos(a) * cx + F.sin(a) * cy + F.col("dx"), F.sin(a), F.cos(a), zero, cy - F.sin(a) * cx - F.cos(a) * cy + F.col("dy"), zero, zero, one, zero, zero, zero, zero, one]
    return F.array(*rows)


def _nearest_groups(between: DataFrame) -> DataFrame:
    """Of pairs of groups (site, a, b, distance) those in which each is the other's nearest; the lesser names among equals."""
    order = F.struct("distance", "a", "b")
    ways = between.select(F.col("a").alias("g"), "site", order.alias("o")).unionByName(between.select(F.col("b").alias("g"), "site", order.alias("o")))
    best = ways.groupBy("g").agg(F.min_by("site", "o").alias("site"), F.min("o").alias("o"))
    return best.groupBy("site", "o").agg(F.count("*").alias("n")).where("n = 2").select("site", "o.a", "o.b", "o.distance")


def _facing(sample: DataFrame, state: DataFrame, pairs: DataFrame, reach: float, voxel: float, most: int) -> DataFrame:
    """The clouds of paired groups (as scan), the fixed one's cropped in Spark to the reach around the moving one's box: at most `most` points each."""
    cloud = moved(sample.join(state.select("scan", "group", "transform"), "scan"), F.col("transform")).withColumn("pid", F.xxhash64("scan", "pid")).drop("scan", "transform").withColumnRenamed("group", "scan")
    cloud = cut(cloud.join(pairs.select(F.col("fixed").alias("scan")).unionByName(pairs.select(F.col("moving").alias("scan"))), "scan", "left_semi"))
    moving = cloud.join(pairs.select(F.col("moving").alias("scan")), "scan", "left_semi")
    box = moving.groupBy("scan").agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"]).withColumnRenamed("scan", "moving")
    inside = [F.col(c).between(F.col(f"lo{c}") - reach, F.col(f"hi{c}") + reach) for c in "xy"]
    fixed = cloud.join(pairs.select(F.col("fixed").alias("scan"), "moving").join(box, "moving"), "scan").where(inside[0] & inside[1]).select(*cloud.columns)
    return cut(grid.voxel_sample(fixed.unionByName(moving), voxel, most))


def _map_choice(cloud: DataFrame, tied: DataFrame, mapped: DataFrame) -> DataFrame:
    """fixed, moving and rank of the hypothesis (site, fixed, moving, rank, transform) under which both clouds lie best on the map."""
    named = cut(tied.withColumn("pair", F.concat_ws("/", "fixed", "moving", "rank")))
    own = named.select("pair", F.col("fixed").alias("scan")).join(cloud, "scan").select(F.col("pair").alias("scan"), "pid", "x", "y", "z")
    theirs = moved(named.select("pair", "transform", F.col("moving").alias("scan")).join(cloud, "scan"), F.col("transform")).select(F.col("pair").alias("scan"), "pid", "x", "y", "z")
    there = mapped.join(named.select("site", "pair"), "site").select(F.col("pair").alias("site"), "kind", "x", "y")
    scores = registration.placed_on_map(map_features(own.unionByName(theirs)), there).where("score is not null").select(F.col("site").alias("pair"), F.col("score").alias("map_score"))
    return named.join(scores, "pair").groupBy("fixed", "moving").agg(F.min_by("rank", F.struct("map_score", "rank")).alias("rank"))


def _map_joins(sample: DataFrame, state: DataFrame, cloud: DataFrame, pairs: DataFrame, mapped: DataFrame, cell: float) -> DataFrame:
    """Fits of pairs (site, fixed, moving) that start where the map places both groups, and stay near: clean, within 3.5 m and 6 degrees."""
    both = pairs.select("site", F.col("fixed").alias("group")).unionByName(pairs.select("site", F.col("moving").alias("group")))
    whole = moved(sample.join(state.select("scan", "group", "transform"), "scan").join(both, "group"), F.col("transform")).select(F.col("group").alias("scan"), "pid", "x", "y", "z")
    there = mapped.join(both, "site").select(F.col("group").alias("site"), "kind", "x", "y")
    placed = cut(registration.placed_on_map(map_features(whole), there).where("applied").select(F.col("site").alias("group"), map_pose().alias("pose")))
    one, two = (placed.select(F.col("group").alias(name), F.col("pose").alias(f"_{name}")) for name in ("fixed", "moving"))
    start = pairs.join(one, "fixed").join(two, "moving").withColumn("d", times(inverse(F.col("_fixed")), F.col("_moving")))
    start = cut(start.select("fixed", "moving", heading(F.col("d")).alias("yaw"), F.col("d")[3].alias("dx"), F.col("d")[7].alias("dy")))
    clean = (F.col("rms") <= 0.10) & F.coalesce(F.col("conflict_rate") <= 0.35, F.lit(True)) & F.coalesce(F.col("objects") >= 0.4, F.lit(True))
    return evaluated(cloud, start, cell).where(clean & (F.col("moved") <= 3.5) & (F.col("turned") <= 6))


def joined(points: DataFrame, scans: DataFrame, yaws: list[float], reach: float = 40.0, voxel: float = 0.1, most: int = 60_000, cell: float = 0.2, tries: int = 6, most_shift: float = 20.0, mapped: DataFrame | None = None, close: float = 8.0, alternatives: int = 3) -> DataFrame:
    """Groups of scans joined pair by pair: scan, site, group, transform into the group's frame, rms, overlap, consistency, placed_by.

    Every scan starts as a group. In each round, all groups of all sites at once, those that are each other's nearest are fitted:
    the whole moving group to the fixed one around it. The group of the site's anchor (the scan with most points) is fixed, else the
    one with more points. A pair that doesn't fit is tried again when one of its groups has grown. mapped (site, kind, x, y)
    decides between up to `alternatives` fits within `close` points of the best, and places groups that the scans cannot join.
    placed_by is scans, map choice or map; null for a group's first scan.
    """
    sample = cut(grid.voxel_sample(points, voxel, most))
    near = cut(neighbouring(points, scans, reach))
    sizes = points.groupBy("scan").agg(F.count("*").alias("n"))
    order = Window.partitionBy("site").orderBy(F.desc("n"), "scan")
    none = F.lit(None)
    state = scans.select("scan", "site").join(sizes, "scan").select("scan", "site", F.col("scan").alias("group"), "n", (F.row_number().over(order) == 1).alias("anchor"), pose(IDENTITY).alias("transform"), *[none.cast("double").alias(c) for c in ("rms", "overlap", "consistency")], none.cast("string").alias("placed_by"))
    state = cut(state)
    failed: DataFrame | None = None
    while True:
        group = state.groupBy("group").agg(F.sum("n").alias("n"), F.count("*").alias("scans"), F.max("anchor").alias("anchor"))
        of = lambda scan, name: state.select(F.col("scan").alias(scan), F.col("group").alias(name))
        between = near.join(of("fixed", "_a"), "fixed").join(of("moving", "_b"), "moving").where("_a <> _b")
        between = between.groupBy("site", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("distance").alias("distance"))
        for side in "ab":
            between = between.join(group.select(F.col("group").alias(side), F.col("scans").alias(f"scans_{side}"), F.col("n").alias(f"n_{side}"), F.col("anchor").alias(f"anchor_{side}")), side)
        if failed is not None:
            between = between.join(failed, ["a", "b", "scans_a", "scans_b"], "left_anti")
        between = cut(between)
        first = F.col("anchor_a") | (~F.col("anchor_b") & (F.col("n_a") >= F.col("n_b")))
        pairs = _nearest_groups(between).join(between.drop("site", "distance"), ["a", "b"])
        pairs = cut(pairs.withColumns({"fixed": F.when(first, F.col("a")).otherwise(F.col("b")), "moving": F.when(first, F.col("b")).otherwise(F.col("a"))}))
        if pairs.isEmpty():
            return state
        cloud = _facing(sample, state, pairs, most_shift + 5, voxel, most)
        found = cut(hypotheses(cloud, pairs, yaws, cell, tries, most_shift).where("accepted"))
        top = found.groupBy("fixed", "moving").agg(F.max("score").alias("_top"))
        found = found.join(top, ["fixed", "moving"]).where((F.col("score") >= F.col("_top") - close) & (F.col("rank") <= 1 + alternatives))
        pick = found.where("rank = 1").select("fixed", "moving", "rank", F.lit("scans").alias("placed_by"))
        extra = None
        if mapped is not None:
            several = found.join(found.where("rank > 1").select("fixed", "moving").distinct(), ["fixed", "moving"], "left_semi")
            chosen = _map_choice(cloud, several.join(pairs.select("site", "fixed", "moving"), ["fixed", "moving"]), mapped).select("fixed", "moving", F.col("rank").alias("_rank"))
            by = F.when(F.col("_rank") != F.col("rank"), "map choice").otherwise(F.col("placed_by"))
            pick = pick.join(chosen, ["fixed", "moving"], "left").select("fixed", "moving", F.coalesce("_rank", "rank").alias("rank"), by.alias("placed_by"))
            left = cut(pairs.join(pick, ["fixed", "moving"], "left_anti").select("site", "fixed", "moving"))
            if not left.isEmpty():
                extra = _map_joins(sample, state, cloud, left, mapped, cell)
        figures = ["fixed", "moving", "transform", "rms", "overlap", "consistency"]
        fits_now = found.join(pick, ["fixed", "moving", "rank"]).select(*figures, "placed_by")
        if extra is not None:
            fits_now = fits_now.unionByName(extra.select(*figures, F.lit("map").alias("placed_by")))
        fits_now = cut(fits_now)
        out = pairs.join(fits_now, ["fixed", "moving"], "left_anti").select("a", "b", "scans_a", "scans_b")
        failed = cut(out if failed is None else failed.unionByName(out))
        step = fits_now.select(F.col("moving").alias("group"), F.col("fixed").alias("_into"), F.col("transform").alias("_t"), *[F.col(c).alias(f"_{c}") for c in ("rms", "overlap", "consistency", "placed_by")])
        met = state.join(step, "group", "left")
        new = F.col("_into").isNotNull()
        state = cut(met.select("scan", "site", F.coalesce("_into", "group").alias("group"), "n", "anchor", F.when(new, times(F.col("_t"), F.col("transform"))).otherwise(F.col("transform")).alias("transform"), *[F.when(new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("rms", "overlap", "consistency", "placed_by")]))


def refined(sample: DataFrame, placed: DataFrame, pairs: DataFrame, fixed: DataFrame, rounds: int = 3, settled: float = 0.01, most_tilt: float = 4.0, margin: float = 3.0, voxel: float = 0.1, most: int = 60_000) -> DataFrame:
    """placed with each scan but the `fixed` ones (scan) fitted to all its placed neighbours, until none moves by `settled` metres.

    All scans of a round are fitted to the poses of the round before. A pose that would tilt over the limit is kept as it was. The
    neighbours' points are cropped to the scan's box and thinned by voxels to `most`, so a task holds at most two samples.
    """
    ways = pairs.select(F.col("fixed").alias("scan"), F.col("moving").alias("other")).unionByName(pairs.select(F.col("moving").alias("scan"), F.col("fixed").alias("other")))
    ways = cut(ways.join(fixed.select("scan"), "scan", "left_anti"))
    kind = placed.schema["scan"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        xyz, own = rows[["x", "y", "z"]].to_numpy(float), rows["own"].to_numpy()
        one, two = xyz[~own], xyz[own]
        step, rms, share = registration.icp(one, two, None, 6, (0.3, 0.1), 20, 0.85, most_tilt) if len(one) > 10 else (np.eye(4), np.inf, 0.0)
        return pd.DataFrame([(key[0], step.ravel().tolist(), rms, share)], columns=["scan", "step", "_rms", "_overlap"])

    for _ in range(rounds):
        cloud = cut(moved(sample.join(placed.select("scan", "transform"), "scan"), F.col("transform")).select("scan", "pid", "x", "y", "z"))
        box = cloud.groupBy("scan").agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
        inside = [F.col(c).between(F.col(f"lo{c}") - margin, F.col(f"hi{c}") + margin) for c in "xy"]
        theirs = ways.join(box, "scan").join(cloud.withColumnRenamed("scan", "other"), "other").where(inside[0] & inside[1])
        theirs = grid.voxel_sample(theirs.select("scan", F.xxhash64("other", "pid").alias("pid"), "x", "y", "z"), voxel, most)
        theirs = cut(theirs.select("scan", F.lit(False).alias("own"), "x", "y", "z"))
        own = cloud.join(ways.select("scan").distinct(), "scan").select("scan", F.lit(True).alias("own"), "x", "y", "z")
        own = own.join(theirs.select("scan").distinct(), "scan", "left_semi")
        steps = theirs.join(placed.select("scan"), "scan", "left_semi").unionByName(own).groupBy("scan").applyInPandas(run, f"scan {kind}, step array<double>, _rms double, _overlap double")
        new = times(F.col("step"), F.col("transform"))
        met = placed.join(steps, "scan", "left").withColumn("_new", new).withColumn("_ok", (F.col("_rms") < float("inf")) & (tilt(F.col("_new")) <= most_tilt))
        pick = lambda new, old: F.when(F.col("_ok"), F.col(new)).otherwise(F.col(old))
        far = F.when(F.col("_ok"), F.sqrt(sum((F.pow(F.col("step")[k], 2) for k in (7, 11)), F.pow(F.col("step")[3], 2)))).otherwise(0.0)
        met = cut(met.withColumns({"transform": pick("_new", "transform"), "rms": pick("_rms", "rms"), "overlap": pick("_overlap", "overlap"), "_far": far}))
        placed = met.select(*[c for c in placed.columns], "_far")
        most = placed.agg(F.max("_far")).first()[0]
        placed = placed.drop("_far")
        if most is None or most < settled:
            break
    return placed


def registered(points: DataFrame, scans: DataFrame, yaws: list[float], reach: float = 40.0, voxel: float = 0.1, most: int = 60_000, cell: float = 0.2, tries: int = 6, most_shift: float = 20.0, mapped: DataFrame | None = None) -> DataFrame:
    """Per scan: site, status (anchor, registered or unmatched), transform, moved_m, turned_deg, rms, overlap, consistency and placed_by.

    The scan with most points anchors its site. most_shift bounds the error of a rough position; points may have colours (r, g, b)
    or a brightness b. See joined() for the fits and the map's part in them; what no fit reaches stays where it was.
    """
    points = bright(points)
    state = joined(points, scans, yaws, reach, voxel, most, cell, tries, most_shift, mapped)
    anchors = cut(state.where("anchor").select("scan", "site", F.col("group").alias("_group")))
    placed = cut(state.join(anchors.select("site", "_group"), "site").where(F.col("group") == F.col("_group")).select("scan", "site", "transform", "rms", "overlap", "consistency", "placed_by"))
    sample = cut(grid.voxel_sample(points.drop("b"), voxel, most))
    placed = refined(sample, placed, cut(neighbouring(points, scans, reach)), anchors, voxel=voxel, most=most)
    centre = points.groupBy("scan").agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))
    status = F.when(F.col("_anchor"), "anchor").when(F.col("transform").isNotNull(), "registered").otherwise("unmatched")
    out = scans.select("scan", "site").join(centre, "scan").join(placed.drop("site"), "scan", "left").join(anchors.select("scan", F.lit(True).alias("_anchor")), "scan", "left").withColumn("status", status)
    out = out.withColumn("transform", F.coalesce("transform", pose(IDENTITY)))
    t, x, y = F.col("transform"), F.col("_x"), F.col("_y")
    far = F.hypot(t[0] * x + t[1] * y + t[3] - x, t[4] * x + t[5] * y + t[7] - y)
    return out.select("scan", "site", "status", "transform", F.round(far, 2).alias("moved_m"), F.round(heading(t), 1).alias("turned_deg"), F.round("rms", 3).alias("rms"), F.round("overlap", 2).alias("overlap"), F.round("consistency", 2).alias("consistency"), "placed_by")


def levelled(points: DataFrame, size: float = 0.5, least: int = 50) -> DataFrame:
    """site, scan and offset: the rise that brings each scan's ground onto the ones merged before it, in order of their names.

    The upper median over the cells that both have, from `least` cells on; else none. Points have a site. One round for
    each place in the order, all sites at once.
    """
    low = cut(points.groupBy("site", "scan", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(F.min("z").alias("z")))
    order = cut(low.select("site", "scan").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy("scan"))))
    n = order.agg(F.max("_k")).first()[0] or 0
    numbered = cut(low.join(order, ["site", "scan"]))
    at = ["site", "cx", "cy"]
    merged = numbered.where("_k = 1").select(*at, "z")
    out = order.where("_k = 1").select("site", "scan", F.lit(0.0).alias("offset"))
    for k in range(2, n + 1):
        own = numbered.where(F.col("_k") == k)
        shared = own.join(merged.select(*at, F.col("z").alias("_m")), at)
        rise = stats.placed(shared, ["site", "scan"], F.col("_m") - F.col("z")).groupBy("site", "scan").agg(F.max("size").alias("_n"), stats.upper_median().alias("_d"))
        rise = cut(order.where(F.col("_k") == k).join(rise, ["site", "scan"], "left").select("site", "scan", F.when(F.col("_n") >= least, F.col("_d")).otherwise(0.0).alias("offset")))
        out = out.unionByName(rise)
        risen = own.join(rise, ["site", "scan"]).select(*at, (F.col("z") + F.col("offset")).alias("z"))
        merged = cut(merged.unionByName(risen).groupBy(*at).agg(F.min("z").alias("z")))
    return out


def stitched(points: DataFrame, scans: DataFrame, placed: DataFrame | None, size: float = 0.5, least: int = 50) -> DataFrame:
    """One cloud per site (site, scan, pid, x, y, z): points under their scan's transform; a site no scan of which was
    registered, or all of them without `placed` (as of registered()), joined where the scans lie, their grounds levelled."""
    cloud = points.join(scans.select("scan", "site"), "scan")
    if placed is None:
        fitted = scans.select("site").limit(0)
    else:
        fitted = placed.where("status = 'registered'").select("site").distinct()
    loose = cloud.join(fitted, "site", "left_anti")
    rise = levelled(loose, size, least)
    out = loose.join(rise, ["site", "scan"]).withColumn("z", F.col("z") + F.col("offset")).select("site", "scan", "pid", "x", "y", "z")
    if placed is None:
        return out
    fit = moved(cloud.join(fitted, "site", "left_semi").join(placed.select("scan", "transform"), "scan"), F.col("transform"))
    return out.unionByName(fit.select("site", "scan", "pid", "x", "y", "z"))


def on_the_map(points: DataFrame, placed: DataFrame, mapped: DataFrame, voxel: float = 0.1, most: int = 240_000) -> DataFrame:
    """site, the motion that lays its fitted scans on the map (column pose; the identity where no placement is good enough) and registration.PLACED's columns."""
    fitted = placed.where("status <> 'unmatched'")
    cloud = moved(points.select("scan", "pid", "x", "y", "z").join(fitted.select("scan", "site", "transform"), "scan"), F.col("transform"))
    sample = grid.voxel_sample(cloud.select(F.col("site").alias("scan"), F.xxhash64("scan", "pid").alias("pid"), "x", "y", "z"), voxel, most)
    found = registration.placed_on_map(map_features(cut(sample)), mapped)
    return cut(found.withColumn("pose", F.when(F.col("applied"), map_pose()).otherwise(pose(IDENTITY))))


def site_scan(points: DataFrame, scans: DataFrame, yaws: list[float], mapped: DataFrame | None = None, **rules) -> tuple[DataFrame, DataFrame]:
    """One cloud per site (site, scan, pid, x, y, z, r, g, b), and a report with a row per scan.

    points: scan, pid, x, y, z, r, g, b in map coordinates; scans: scan, site, kind (las or ply). What is done with a site, by the
    report's rung: `single` passes as it is; `registered` scans are fitted together (see registered(), which takes the rules), placed on
    the map where mapped (site, kind, x, y) lets them, and the unmatched ones kept where they were; `rough positions` where no scan was
    fitted: joined where they lie, grounds levelled; `as they are` for ply, which has no map position; `refused`, without a
    cloud, for sites that mix both. The report has scan, site, rung, status, transform (of the raw points), moved_m, turned_deg, rms,
    overlap, consistency, placed_by, and of the map applied, shift_m, map_degrees, walls, poles and why.
    """
    kinds = scans.groupBy("site").agg(F.count_distinct("kind").alias("kinds"), F.min("kind").alias("kind"), F.count("*").alias("n"))
    rung = F.when(F.col("n") == 1, "single").when(F.col("kinds") > 1, "refused").when(F.col("kind") == "ply", "as they are").otherwise("fit")
    plan = cut(scans.select("scan", "site").join(kinds.select("site", rung.alias("rung")), "site"))
    try_fit = plan.where("rung = 'fit'").select("scan", "site")
    own = points.join(try_fit.select("scan"), "scan", "left_semi")
    none = F.lit(None)
    names = ["moved_m", "turned_deg", "rms", "overlap", "consistency"]
    map_names = {"applied": "boolean", "shift_m": "double", "map_degrees": "double", "walls": "double", "poles": "double", "why": "string"}
    report = plan.where("rung <> 'fit'").select("scan", "site", "rung", none.cast("string").alias("status"), pose(IDENTITY).alias("transform"), *[none.cast("double").alias(c) for c in names], none.cast("string").alias("placed_by"), *[none.cast(k).alias(c) for c, k in map_names.items()])
    colours = ["r", "g", "b"]
    cloud = points.join(plan.where("rung in ('single', 'as they are')").select("scan", "site"), "scan").select("site", "scan", "pid", "x", "y", "z", *colours)
    if try_fit.isEmpty():
        return cloud, report
    placed = cut(registered(own, try_fit, yaws, mapped=mapped, **rules))
    good = placed.groupBy("site").agg(F.max(F.col("status") == "registered").alias("good"))
    placed = placed.join(good, "site")
    if mapped is None:
        laid = placed.select("site").distinct().select("site", pose(IDENTITY).alias("pose"), *[none.cast(k).alias(c) for c, k in map_names.items()])
    else:
        laid = on_the_map(own, placed.where("good"), mapped, rules.get("voxel", 0.1)).select("site", "pose", "applied", F.hypot("dx", "dy").alias("shift_m"), F.col("degrees").alias("map_degrees"), "walls", "poles", "why")
    met = placed.join(laid, "site", "left").withColumn("pose", F.coalesce("pose", pose(IDENTITY)))
    final = F.when(F.col("good") & (F.col("status") != "unmatched"), times(F.col("pose"), F.col("transform"))).otherwise(pose(IDENTITY))
    met = cut(met.withColumn("transform", final).withColumn("rung", F.when(F.col("good"), "registered").otherwise("rough positions")))
    report = report.unionByName(met.select(*report.columns))
    fitted = met.where("good")
    moved_points = moved(own.join(fitted.select("scan", "site", "transform"), "scan"), F.col("transform")).select("site", "scan", "pid", "x", "y", "z", *colours)
    loose = own.join(met.where("not good").select("scan", "site"), "scan")
    level = levelled(loose)
    loose = loose.join(level, ["site", "scan"]).withColumn("z", F.col("z") + F.col("offset")).select("site", "scan", "pid", "x", "y", "z", *colours)
    return cloud.unionByName(moved_points).unionByName(loose), report


def site_files(cloud: DataFrame) -> DataFrame:
    """scan (the site's name) and content: a LAS file per site of site_scan's cloud, in order of scan and pid. A site is one file by nature."""
    from ..sources.clouds import las_files

    order = F.row_number().over(Window.partitionBy("site").orderBy("scan", "pid")).cast("long")
    return las_files(cloud.select(F.col("site").cast("string").alias("scan"), order.alias("pid"), "x", "y", "z", "r", "g", "b"))
