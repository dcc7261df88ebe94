"""Point clouds as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import fits, grid, registration
from . import tables as t

P = f"WITH {t.POINTS}"
CELLS = "CAST(floor(x / 0.5::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 0.5::DOUBLE) AS BIGINT) AS cy"


def grid_minimum(spark: SparkSession, d: str) -> DataFrame:
    return grid.ground(t.points(spark, d), 0.5)


def density_filter(spark: SparkSession, d: str) -> DataFrame:
    return grid.dense_cells(t.points(spark, d), 0.5)


DENSITY_SQL = f"{P}, c AS (SELECT scan, {CELLS}, count(*) AS n FROM points GROUP BY ALL), m AS (SELECT scan, list_sort(list(n)) AS s FROM c GROUP BY 1) SELECT c.scan, cx, cy, n FROM c JOIN m ON m.scan = c.scan WHERE n >= greatest(2, s[CAST(floor(len(s) * 0.5::DOUBLE) + 1 AS BIGINT)] / 4)"


def voxel_subsample(spark: SparkSession, d: str) -> DataFrame:
    return grid.voxel_sample(t.points(spark, d), 1.0, 20)


VOXEL_SQL = f"{P}, v AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY scan, floor(x), floor(y), floor(z) ORDER BY pid) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY pid) - 1 AS k, count(*) OVER (PARTITION BY scan) AS c FROM v) SELECT scan, pid, x, y, z FROM n WHERE k % CAST(ceil(c / 20) AS BIGINT) = 0"


def stride_thinning(spark: SparkSession, d: str) -> DataFrame:
    return grid.thin(t.points(spark, d), 25)


def height_trim(spark: SparkSession, d: str) -> DataFrame:
    return grid.trimmed_height(t.points(spark, d), 0.5, 1.0)


def up_axis(spark: SparkSession, d: str) -> DataFrame:
    return grid.up_axis(t.points(spark, d), 0.25).withColumn("share", F.round("share", 6))


UP_SQL = f"{P}, a AS (SELECT scan, unnest([{{'k': 0, 'b': floor(x / 0.25::DOUBLE + 0.5)}}, {{'k': 1, 'b': floor(y / 0.25::DOUBLE + 0.5)}}, {{'k': 2, 'b': floor(z / 0.25::DOUBLE + 0.5)}}], recursive := true) FROM points), n AS (SELECT scan, k, b, count(*) AS n FROM a GROUP BY ALL), c AS (SELECT scan, count(*) AS c FROM points GROUP BY 1) SELECT n.scan, ['x', 'y', 'z'][k + 1] AS axis, round(n / c, 6) AS share FROM n JOIN c ON c.scan = n.scan QUALIFY row_number() OVER (PARTITION BY n.scan ORDER BY n DESC, k) = 1"


def occupied_cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.occupied(t.points(spark, d), 2.0, ground_below=0.0).withColumn("top", F.round("top", 4))


OCCUPIED_SQL = f"{P}, c AS (SELECT *, CAST(floor(x / 2) AS BIGINT) AS cx, CAST(floor(y / 2) AS BIGINT) AS cy FROM points), g AS (SELECT scan, cx, cy, min(z) AS f FROM c GROUP BY ALL HAVING min(z) < 0) SELECT c.scan, c.cx, c.cy, CAST(sum(CASE WHEN z - f BETWEEN 0.1 AND 2.2 THEN 1 ELSE 0 END) AS BIGINT) AS risers, round(max(z - f), 4) AS top, sum(CASE WHEN z - f BETWEEN 0.1 AND 2.2 THEN 1 ELSE 0 END) >= 3 AS blocked FROM c JOIN g ON g.scan = c.scan AND g.cx = c.cx AND g.cy = c.cy GROUP BY 1, 2, 3"


def level_offsets(spark: SparkSession, d: str) -> DataFrame:
    return grid.level_offsets(t.points(spark, d), 2.0, 3).select("scan", "other", "cells", F.round("offset", 4).alias("offset"))


LEVEL_SQL = f"{P}, g AS (SELECT scan, floor(x / 2) AS cx, floor(y / 2) AS cy, min(z) AS z FROM points GROUP BY ALL), m AS (SELECT a.scan, b.scan AS other, list_sort(list(b.z - a.z)) AS s FROM g a JOIN g b ON a.cx = b.cx AND a.cy = b.cy AND a.scan < b.scan GROUP BY 1, 2) SELECT scan, other, CAST(len(s) AS BIGINT) AS cells, round(s[CAST(floor(len(s) * 0.5::DOUBLE) + 1 AS BIGINT)], 4) AS \"offset\" FROM m WHERE len(s) >= 3"


def ground_line_fit(spark: SparkSession, d: str) -> DataFrame:
    return grid.line_fit(t.points(spark, d), inlier=1.5).select("scan", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), "n")


LINE_SQL = f"{P}, f1 AS (SELECT scan, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM points GROUP BY 1), f2 AS (SELECT p.scan, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM points p JOIN f1 ON f1.scan = p.scan WHERE abs(y - s * x - i) <= 1.5 GROUP BY 1) SELECT p.scan, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept, count(*) AS n FROM points p JOIN f2 ON f2.scan = p.scan WHERE abs(y - s * x - i) <= 1.5 GROUP BY 1"


def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    return grid.plane_fit(t.points(spark, d)).select("scan", "n", *[F.round(c, 6).alias(c) for c in "abc"])


PLANE_SQL = f"{P}, m AS (SELECT scan, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM points GROUP BY 1), s AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM m) SELECT scan, n, round(a, 6) AS a, round(b, 6) AS b, round(mz - a * mx - b * my, 6) AS c FROM s"


def robust_plane(spark: SparkSession, d: str) -> DataFrame:
    return grid.robust_plane(t.points(spark, d)).select("scan", "n", *[F.round(c, 6).alias(c) for c in "abc"])


def nearest_neighbour_radius(spark: SparkSession, d: str) -> DataFrame:
    p = t.points(spark, d)
    return grid.neighbours(p, p, 0.8, 3).select("pid", "other", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


NEAR_SQL = f"{P}, m AS (SELECT a.pid, b.pid AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dd FROM points a, points b WHERE a.pid <> b.pid), n AS (SELECT pid, other, dd, row_number() OVER (PARTITION BY pid ORDER BY dd, other) AS rank FROM m WHERE dd <= 0.8) SELECT pid, other, round(dd, 5) AS distance, rank FROM n WHERE rank <= 3"


def fit_quality(spark: SparkSession, d: str) -> DataFrame:
    p = t.points(spark, d)
    n = p.count()
    return grid.fit_quality(grid.neighbours(p, p, 0.8), n).select(F.round("rms", 6).alias("rms"), F.round("overlap", 6).alias("overlap"))


def top_render(spark: SparkSession, d: str) -> DataFrame:
    return grid.render(t.points(spark, d), 0.5)


def rigid_transform(spark: SparkSession, d: str) -> DataFrame:
    m = [0.8, -0.6, 0.0, 1.0, 0.6, 0.8, 0.0, -2.0, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0]
    return grid.transformed(t.points(spark, d), m).select("pid", *[F.round(c, 5).alias(c) for c in "xyz"])


def height_over_ground(spark: SparkSession, d: str) -> DataFrame:
    return grid.height_over_ground(t.points(spark, d), 3.0).groupBy("scan").agg(F.round(F.avg("h"), 8).alias("mean_h"), F.round(stats.share(F.col("h") > 1), 8).alias("share_high"))


HEIGHT_SQL = f"{P}, c AS (SELECT *, floor(x / 3) AS cx, floor(y / 3) AS cy FROM points), g AS (SELECT scan, cx, cy, CASE WHEN count(*) > 10 THEN quantile_cont(z, 0.05) ELSE min(z) END AS g FROM c GROUP BY 1, 2, 3) SELECT c.scan, round(avg(z - g), 8) AS mean_h, round(avg(CAST(z - g > 1 AS DOUBLE)), 8) AS share_high FROM c JOIN g ON g.scan = c.scan AND g.cx = c.cx AND g.cy = c.cy GROUP BY 1"


def main_direction(spark: SparkSession, d: str) -> DataFrame:
    s = t.points(spark, d).select(F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return grid.main_direction(s).select(F.round("direction", 5).alias("direction"))


DIRECTION_SQL = f"{P}, s AS (SELECT degrees(atan2(y, x)) - 180 * floor(degrees(atan2(y, x)) / 180) AS a, sqrt(x * x + y * y) AS l FROM points WHERE x <> 0 OR y <> 0), m AS (SELECT floor(a * 2) / 2 + 0.25 AS md FROM s GROUP BY floor(a * 2) ORDER BY sum(l) DESC, floor(a * 2) LIMIT 1), q AS (SELECT degrees(atan2(sum(l * sin(2 * radians(a))), sum(l * cos(2 * radians(a)))) / 2) AS r FROM s, m WHERE abs((a - md + 90) - 180 * floor((a - md + 90) / 180) - 90) <= 3) SELECT round(r - 180 * floor(r / 180), 5) AS direction FROM q"

def point_normals(spark: SparkSession, d: str) -> DataFrame:
    return registration.with_normals(t.points(spark, d), 6, 1.5, 4.0)


def coarse_registration(spark: SparkSession, d: str) -> DataFrame:
    p = grid.voxel_sample(t.points(spark, d), 0.05, 60_000)
    scans = p.select(F.col("scan").alias("moving")).distinct()
    pairs = scans.select((F.col("moving") - 1).alias("fixed"), "moving").join(scans.withColumnRenamed("moving", "fixed"), "fixed", "left_semi")
    return registration.coarse_search(p, pairs, [-10.0, 0.0, 10.0], 0.5, least=1.0)


def refined_registration(spark: SparkSession, d: str) -> DataFrame:
    p = grid.voxel_sample(t.points(spark, d), 0.05, 60_000)
    best = coarse_registration(spark, d).groupBy("fixed", "moving").agg(F.max_by(F.struct("yaw", "dx", "dy"), "score").alias("b")).select("fixed", "moving", "b.*")
    return registration.refine(p, best, 4)


def _clouds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each scan placed against the next one; the height a twentieth of z for ground, its amount for walls; a brightness and a normal from the key."""
    p = t.points(spark, d).withColumn("b", (F.col("pid") * 37 % 101).cast("double"))
    normal = {"nx": F.when(F.col("pid") % 2 == 0, 0.6).otherwise(1.0), "ny": F.when(F.col("pid") % 2 == 0, 0.8).otherwise(0.0), "nz": F.lit(0.0)}
    return p.withColumnRenamed("scan", "pair"), p.withColumn("pair", F.col("scan") - 1).drop("scan").withColumns(normal)


def wall_fit(spark: SparkSession, d: str) -> DataFrame:
    m, f = (c.withColumn("h", F.abs("z")) for c in _clouds(spark, d))
    out = fits.wall_fit(m, f, 1.5, 0.3, 8, 5)
    return out.select("pair", "wall_points", "wall_close", F.round("wall_fit", 9).alias("wall_fit"))


WALL_SQL = f"""{P}, m AS (SELECT a.scan AS pair, a.pid, b.pid AS fid, abs(b.z) BETWEEN 0.3 AND 3 AS wall, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2,
abs((a.x - b.x) * CASE WHEN b.pid % 2 = 0 THEN 0.6::DOUBLE ELSE 1 END + (a.y - b.y) * CASE WHEN b.pid % 2 = 0 THEN 0.8::DOUBLE ELSE 0 END) AS off FROM points a JOIN points b ON b.scan = a.scan + 1 WHERE abs(a.z) BETWEEN 0.3 AND 3),
n AS (SELECT * FROM m WHERE d2 <= 2.25 QUALIFY row_number() OVER (PARTITION BY pair, pid ORDER BY d2, fid) <= 8), o AS (SELECT pair, pid, min(off) AS off FROM n WHERE wall GROUP BY 1, 2)
SELECT pair, count(*) AS wall_points, count(*) FILTER (off < 0.3::DOUBLE) AS wall_close, round(count(*) FILTER (off < 0.3::DOUBLE) / count(*), 9) AS wall_fit FROM o GROUP BY 1 HAVING count(*) >= 5"""


def ground_texture(spark: SparkSession, d: str) -> DataFrame:
    m, f = (c.withColumn("h", F.col("z") / 20) for c in _clouds(spark, d))
    return fits.ground_texture(m, f, 0.8, 5).select("pair", "texture_cells", F.round("ncc", 6).alias("ncc"))


TEXTURE_SQL = f"""{P}, p AS (SELECT *, CAST(pid * 37 % 101 AS DOUBLE) AS b FROM points), k AS (SELECT scan AS pair, min(x) AS x0, min(y) AS y0 FROM p GROUP BY 1), a AS (SELECT scan AS pair, * FROM p UNION ALL SELECT scan - 1, * FROM p),
c AS (SELECT a.pair, a.scan = a.pair AS own, floor((x - x0) / 0.8::DOUBLE) AS cx, floor((y - y0) / 0.8::DOUBLE) AS cy, avg(b) AS b FROM a JOIN k ON k.pair = a.pair WHERE abs(z / 20) <= 0.1 GROUP BY ALL)
SELECT m.pair, count(*) AS texture_cells, round(coalesce(corr(f.b, m.b), 0), 6) AS ncc FROM c m JOIN c f ON m.pair = f.pair AND m.cx = f.cx AND m.cy = f.cy WHERE m.own AND NOT f.own GROUP BY 1 HAVING count(*) >= 5"""


def filled_render(spark: SparkSession, d: str) -> DataFrame:
    out = grid.filled(grid.render(t.points(spark, d), 0.5).select("scan", "cx", "cy", "z"), ["z"])
    return out.select("scan", "cx", "cy", F.round("z", 8).alias("z"), "filled")


FILLED_SQL = f"""{P}, p0 AS (SELECT scan, cx, cy, max(z) AS z, 0 AS filled FROM (SELECT *, {CELLS} FROM points) GROUP BY 1, 2, 3), o AS (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) WHERE i <> 0 OR j <> 0),
n1 AS (SELECT scan, cx + i AS cx, cy + j AS cy, avg(z) AS z, 1 AS filled FROM p0, o GROUP BY 1, 2, 3 HAVING count(*) >= 4), p1 AS (SELECT * FROM p0 UNION ALL SELECT * FROM n1 WHERE (scan, cx, cy) NOT IN (SELECT (scan, cx, cy) FROM p0)),
n2 AS (SELECT scan, cx + i AS cx, cy + j AS cy, avg(z) AS z, 2 AS filled FROM p1, o GROUP BY 1, 2, 3 HAVING count(*) >= 4), p2 AS (SELECT * FROM p1 UNION ALL SELECT * FROM n2 WHERE (scan, cx, cy) NOT IN (SELECT (scan, cx, cy) FROM p1))
SELECT scan, cx, cy, round(z, 8) AS z, filled FROM p2"""


def height_minima(spark: SparkSession, d: str) -> DataFrame:
    return grid.minima(grid.render(t.points(spark, d), 0.5, top=False).select("scan", "cx", "cy", "z"), "z", 3)


MINIMA_SQL = f"""WITH RECURSIVE {P.removeprefix("WITH ")}, c AS (SELECT scan, cx, cy, min(z) AS z FROM (SELECT *, {CELLS} FROM points) GROUP BY 1, 2, 3),
m AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.scan = c.scan AND abs(b.cx - c.cx) <= 1 AND abs(b.cy - c.cy) <= 1 AND b.z < c.z)),
k AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY z, cx, cy) AS k FROM m),
g AS (SELECT scan, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, z DOUBLE)[]) AS kept FROM (SELECT DISTINCT scan FROM k)
UNION ALL SELECT g.scan, k.k, CASE WHEN len(list_filter(g.kept, lambda q: abs(q.x - k.cx) < 3 AND abs(q.y - k.cy) < 3)) > 0 THEN g.kept ELSE list_append(g.kept, {{'x': CAST(k.cx AS DOUBLE), 'y': CAST(k.cy AS DOUBLE), 'z': k.z}}) END FROM g JOIN k ON k.scan = g.scan AND k.k = g.k + 1),
w AS (SELECT scan, unnest(kept) AS q FROM g QUALIFY row_number() OVER (PARTITION BY scan ORDER BY k DESC) = 1)
SELECT scan, CAST(q.x AS BIGINT) AS cx, CAST(q.y AS BIGINT) AS cy, q.z AS z FROM w"""


QUERIES = {
    "filled_render": (filled_render, FILLED_SQL),
    "height_minima": (height_minima, MINIMA_SQL),
    "grid_minimum": (grid_minimum, f"{P}, c AS (SELECT *, {CELLS} FROM points) SELECT scan, cx, cy, count(*) OVER (PARTITION BY scan, cx, cy) AS n, z, pid, x, y FROM c QUALIFY row_number() OVER (PARTITION BY scan, cx, cy ORDER BY z, pid) = 1"),
    "density_filter": (density_filter, DENSITY_SQL),
    "voxel_subsample": (voxel_subsample, VOXEL_SQL),
    "stride_thinning": (stride_thinning, f"{P}, n AS (SELECT scan, CAST(ceil(count(*) / 25) AS BIGINT) AS s FROM points GROUP BY 1) SELECT p.* FROM points p JOIN n ON n.scan = p.scan WHERE pid % s = 0"),
    "height_trim": (height_trim, f"{P}, m AS (SELECT scan, median(z) AS m FROM points GROUP BY 1) SELECT p.* FROM points p JOIN m ON m.scan = p.scan WHERE z > m - 0.5 AND z < m + 1"),
    "up_axis": (up_axis, UP_SQL),
    "occupied_cells": (occupied_cells, OCCUPIED_SQL),
    "level_offsets": (level_offsets, LEVEL_SQL),
    "ground_line_fit": (ground_line_fit, LINE_SQL),
    "plane_fit": (plane_fit, PLANE_SQL),
    "robust_plane": (robust_plane, None),
    "nearest_neighbour_radius": (nearest_neighbour_radius, NEAR_SQL),
    "fit_quality": (fit_quality, f"{P}, m AS (SELECT a.pid, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS dd FROM points a, points b WHERE a.pid <> b.pid GROUP BY 1) SELECT round(sqrt(avg(dd * dd)), 6) AS rms, round(count(*) / (SELECT count(*) FROM points), 6) AS overlap FROM m WHERE dd <= 0.8"),
    "top_render": (top_render, f"{P}, c AS (SELECT *, {CELLS} FROM points) SELECT scan, cx, cy, z, pid FROM c QUALIFY row_number() OVER (PARTITION BY scan, cx, cy ORDER BY z DESC, pid DESC) = 1"),
    "rigid_transform": (rigid_transform, f"{P} SELECT pid, round(0.8::DOUBLE * x - 0.6::DOUBLE * y + 1, 5) AS x, round(0.6::DOUBLE * x + 0.8::DOUBLE * y - 2, 5) AS y, round(z + 0.5::DOUBLE, 5) AS z FROM points"),
    "point_normals": (point_normals, None),
    "coarse_registration": (coarse_registration, None),
    "refined_registration": (refined_registration, None),
    "height_over_ground": (height_over_ground, HEIGHT_SQL),
    "wall_fit": (wall_fit, WALL_SQL),
    "ground_texture": (ground_texture, TEXTURE_SQL),
    "main_direction": (main_direction, DIRECTION_SQL),
}
