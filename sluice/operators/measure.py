"""Street measurements from one scan: grade, kerb, footpath width, obstacles, plausibility.

The profile is relational: strips along and across a street axis are grouped cells. Sequences along a strip are
ordered window expressions. Points have scan, pid, x, y, z with z up.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from .runs import longest_run, pinch

#: The least points and length, the plausible kerb, the widest step between bins.
LEAST_POINTS, LEAST_LENGTH, KERB, LEAST_WIDTH = 2000, 2.0, (0.06, 0.25), 1.5
#: A step that may be a kerb when the street's heading is sought, and how flat the ground beside it is.
STEP, FLAT = (0.06, 0.3), 0.03


def rotated(points: DataFrame, degrees: float | Column) -> DataFrame:
    """u along and v across an axis at an angle to x."""
    a = F.radians(F.lit(degrees) if isinstance(degrees, (int, float)) else degrees)
    return points.withColumns({"u": F.col("x") * F.cos(a) + F.col("y") * F.sin(a), "v": F.col("y") * F.cos(a) - F.col("x") * F.sin(a)})


def profile(points: DataFrame, bin_size: float = 0.05) -> DataFrame:
    """Height across the street: upper median of the lowest points of the cells along each bin of v."""
    cells = points.withColumns({"bv": F.floor(F.col("v") / bin_size), "bu": F.floor(F.col("u") / 0.25)}).groupBy("scan", "bv", "bu").agg(F.min("z").alias("z"))
    keys = ["scan", "bv"]
    return stats.placed(cells, keys, F.col("z")).groupBy(*keys).agg(stats.upper_median().alias("z"), F.max("size").alias("n"))


def steps(prof: DataFrame, near: int = 1, far: int = 8) -> DataFrame:
    """Rise across each bin: median of the bins behind against those ahead, leaving out the nearest."""
    w = Window.partitionBy("scan").orderBy("bv")
    med = lambda lo, hi: F.sort_array(F.collect_list("z").over(w.rangeBetween(lo, hi)))
    mid = lambda a: F.get(a, F.floor(F.size(a) / 2).cast("int"))
    behind, ahead = med(-far, -near), med(near, far)
    enough = (F.size(behind) >= far // 2) & (F.size(ahead) >= far // 2)
    return prof.withColumn("rise", F.when(enough, mid(behind) - mid(ahead)))


def kerb(prof: DataFrame) -> DataFrame:
    """Per scan the place and height of the greatest step, if it is a plausible kerb."""
    best = steps(prof).where("rise is not null").groupBy("scan").agg(F.max(F.struct(F.abs("rise").alias("height"), (-F.col("bv")).alias("at"), "rise")).alias("k"))
    return best.select("scan", (-F.col("k.at")).alias("bv"), F.col("k.height").alias("height"), F.signum("k.rise").alias("side")).where(F.col("height").between(*KERB))


def street_angle(points: DataFrame, step: int = 3) -> DataFrame:
    """Per scan the heading, in steps of some degrees, across which flat ground meets flat ground at the highest kerb-like step; the smallest among equals.

    Strips of 10 cm hold the lowest points of 20 cm cells, four at least, and their middle mean: a strip that mixes road and footpath
    lies between both, where a median would jump like a kerb at any heading. Flat means that all three strips beside the step
    agree, so that the strips of a wrong heading, each with another mix, rarely pass. Scans without such a step have no row.
    """
    low = F.min(F.struct("z", "x", "y")).alias("p")
    cells = points.groupBy("scan", F.floor(F.col("x") / 0.2), F.floor(F.col("y") / 0.2)).agg(low).select("scan", "p.*")
    turned = rotated(cells.withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(179), F.lit(step)))), F.col("angle"))
    keys = ["scan", "angle", "strip"]
    strips = stats.placed(turned.withColumn("strip", F.floor(F.col("v") / 0.1)), keys, F.col("z")).groupBy(*keys).agg(stats.middle_mean().alias("z"), F.max("size").alias("n")).where("n >= 4")
    w = Window.partitionBy("scan", "angle").orderBy("strip")
    at = lambda d: F.min("z").over(w.rangeBetween(d, d))
    flat = lambda d: F.greatest(*[at(d + k) for k in (-1, 0, 1)]) - F.least(*[at(d + k) for k in (-1, 0, 1)]) <= FLAT
    whole = [at(k).isNotNull() for k in (-4, -3, -2, 2, 3, 4)]
    found = strips.withColumn("rise", F.when(reduce(and_, whole, flat(-3) & flat(3)), F.round(F.abs(at(3) - at(-3)), 6)))
    best = found.where(F.col("rise").between(*STEP)).groupBy("scan").agg(F.max(F.struct("rise", (-F.col("angle")).alias("a"))).alias("m"))
    return best.select("scan", (-F.col("m.a")).alias("angle"))


def obstacles(points: DataFrame, cell: float = 0.1, low: float = 0.1, high: float = 2.2, least: int = 3) -> DataFrame:
    """Cells along the footpath (u, v from the kerb) that something stands in, with its top."""
    ground = points.groupBy("scan", F.floor(F.col("u") / 0.5).alias("gu"), F.floor(F.col("v") / 0.5).alias("gv")).agg(F.min("z").alias("g"))
    p = points.withColumns({"gu": F.floor(F.col("u") / 0.5), "gv": F.floor(F.col("v") / 0.5)}).join(ground, ["scan", "gu", "gv"]).withColumn("h", F.col("z") - F.col("g"))
    c = p.where(F.col("h").between(low, high)).groupBy("scan", F.floor(F.col("u") / cell).alias("iu"), F.floor(F.col("v") / cell).alias("iv")).agg(F.count("*").alias("n"), F.max("h").alias("top"))
    return c.where(F.col("n") >= least)


def clear_widths(points: DataFrame, blocked: DataFrame, cell: float = 0.1, slice_m: float = 0.5) -> DataFrame:
    """Per scan and slice along the street the longest free run of footpath cells, one missing cell bridged."""
    floor_cells = points.groupBy("scan", F.floor(F.col("u") / slice_m).alias("slice"), F.floor(F.col("v") / cell).alias("iv")).agg(F.count("*").alias("n"))
    b = blocked.select("scan", F.floor(F.col("iu") * cell / slice_m + 1e-9).alias("slice"), "iv").distinct()
    free = floor_cells.join(b, ["scan", "slice", "iv"], "left_anti")
    # a blocked cell ends a run even where only one cell is blocked: runs are taken between blocked cells
    w = Window.partitionBy("scan", "slice").orderBy("iv")
    marks = free.select("scan", "slice", "iv", F.lit(0).alias("hit")).unionByName(b.select("scan", "slice", "iv", F.lit(1).alias("hit")))
    parts = marks.withColumn("part", F.sum("hit").over(w)).where("hit = 0")
    return longest_run(parts, ["scan", "slice", "part"], "iv").groupBy("scan", "slice").agg((F.max("length") * cell).alias("clear_m"))


def narrowest(widths: DataFrame) -> DataFrame:
    return pinch(widths, ["scan"], "slice", "clear_m")


def acceptance(n_points: Column, length_m: Column, kerb_m: Column, width_m: Column) -> Column:
    """Why a scan can't be measured, the first reason that holds; null for a good one."""
    return F.when(n_points < LEAST_POINTS, "too few points").when(length_m < LEAST_LENGTH, "too short").when(kerb_m.isNull() | ~kerb_m.between(*KERB), "no kerb found").when(width_m < LEAST_WIDTH, "implausible width")


def measured(points: DataFrame) -> DataFrame:
    """One row per scan: heading, length, kerb height, typical and narrowest clear width and where, and why it is refused if it is.

    A scan without a kerb-like step has no heading; it is measured along x and refused.
    """
    p = rotated(points.join(street_angle(points), "scan", "left"), F.coalesce("angle", F.lit(0)))
    k = kerb(profile(p))
    # the footpath is the higher side of the kerb, out to 5 m
    path = p.join(k.withColumnRenamed("bv", "kv"), "scan").withColumn("v", (F.col("kv") * 0.05 - F.col("v")) * F.col("side"))
    path = path.where(F.col("v").between(0.1, 5.0))
    widths = clear_widths(path, obstacles(path))
    tight = narrowest(widths).join(widths.groupBy("scan").agg(F.median("clear_m").alias("clear_m")), "scan")  # a group is a scan's slices
    size = p.groupBy("scan").agg(F.count("*").alias("n_points"), (F.max("u") - F.min("u")).alias("length_m"), F.first("angle").alias("angle"))
    out = size.join(k.select("scan", F.col("height").alias("kerb_m")), "scan", "left").join(tight.select("scan", "clear_m", F.col("pinch").alias("min_clear_m"), F.col("at").alias("slice")), "scan", "left")
    reason = acceptance(F.col("n_points"), F.col("length_m"), F.col("kerb_m"), F.col("clear_m"))
    return out.withColumn("refused", reason)


def preview(points: DataFrame, pixel: float = 0.05) -> DataFrame:
    """Least and greatest height per pixel, with the scan's 5 % and 95 % heights for shading."""
    q = points.groupBy("scan").agg(F.percentile("z", F.lit(0.05)).alias("dark"), F.percentile("z", F.lit(0.95)).alias("light"))
    px = points.groupBy("scan", F.floor(F.col("x") / pixel).alias("px"), F.floor(F.col("y") / pixel).alias("py")).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return px.join(q, "scan")


def ortho(points: DataFrame, pixel: float = 0.025, band: float = 0.4) -> DataFrame:
    """Mean colour per pixel of the points within `band` of the ground (column h)."""
    near = points.where(F.abs("h") <= band)
    return near.groupBy("scan", F.floor(F.col("x") / pixel).alias("px"), F.floor(F.col("y") / pixel).alias("py")).agg(*[F.avg(c).alias(c) for c in "rgb"])


def densified(rings: DataFrame, step: float = 0.05) -> DataFrame:
    """Points every `step` along segments (ax, ay, bx, by)."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / step).cast("int"))
    k = rings.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("_k") / F.col("_n")
    return k.withColumns({"x": F.col("ax") + t * (F.col("bx") - F.col("ax")), "y": F.col("ay") + t * (F.col("by") - F.col("ay"))}).drop("_n", "_k")


def evidence(fits: DataFrame) -> DataFrame:
    """Rank of registration hypotheses by summed evidence, whether they pass the hard gates, and their order within each pair.

    fits: fixed, moving, yaw (of the fit, degrees), shift (of the fit, m), rms, overlap, near (points); of the comparison
    of both clouds agree, conflict (cells), object_agree, object_conflict, consistency, conflict_rate and objects (shares);
    ncc and texture_cells of the ground's texture; wall_close, wall_points and wall_fit. Evidence that a fit lacks is null
    and neither counts nor rejects. A rejected fit ranks 1000 lower.
    """
    none_or = lambda c, ok: F.col(c).isNull() | ok
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    # Gates and weights.
    good = ((F.col("overlap") >= 0.10) | (F.col("near") >= 1500)) & (F.col("rms") <= 0.10) & none_or("consistency", (F.col("consistency") >= 0.55) & (F.col("conflict_rate") <= 0.35)) & none_or("wall_fit", F.col("wall_fit") >= 0.2) & none_or("objects", F.col("objects") >= 0.4)
    objects = zero(1.2 * F.col("object_agree") - 3.0 * F.col("object_conflict"))
    cells = zero(0.02 * F.col("agree") - 0.2 * F.col("conflict"))
    texture = zero(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), 0.2 * F.col("ncc") * F.sqrt("texture_cells"))))
    texture = F.when(F.col("ncc").isNull(), 0.0).otherwise(texture)
    walls = zero(0.02 * F.col("wall_close") - 0.03 * (F.col("wall_points") - F.col("wall_close")))
    prior = -0.5 * F.pow(F.col("shift") / 10, 2) - 0.5 * F.pow(F.col("yaw") / 15, 2)
    out = fits.withColumn("accepted", F.coalesce(good, F.lit(False)))
    out = out.withColumn("score", objects + cells + texture + walls + prior - F.when(F.col("accepted"), 0.0).otherwise(1000.0))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("fixed", "moving").orderBy(F.desc(F.round("score", 9)), "yaw")))
