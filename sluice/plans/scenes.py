"""Scans placed against each other, and what they show of a site, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fits, placing, scene
from . import tables as t

P = f"WITH {t.POINTS}"
H = "CASE WHEN pid % 3 = 0 THEN 0.01::DOUBLE ELSE abs(z) END"
PLACED = f"{P}, p AS (SELECT *, {H} AS h, CASE WHEN pid % 2 = 0 THEN 0.6::DOUBLE ELSE 1 END AS nx, CASE WHEN pid % 2 = 0 THEN 0.8::DOUBLE ELSE 0 END AS ny, CASE WHEN pid % 5 = 0 THEN 1.0::DOUBLE ELSE 0 END AS nz FROM points)"


def _height() -> Column:
    return F.when(F.col("pid") % 3 == 0, 0.01).otherwise(F.abs("z"))


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each scan (pair: its number) placed against the next one; a third of the points is ground; normals from the key."""
    even = F.col("pid") % 2 == 0
    p = t.points(spark, d).withColumns({"h": _height(), "nx": F.when(even, 0.6).otherwise(1.0), "ny": F.when(even, 0.8).otherwise(0.0), "nz": F.when(F.col("pid") % 5 == 0, 1.0).otherwise(0.0)})
    return p.withColumnRenamed("scan", "pair"), p.withColumn("pair", F.col("scan") - 1).drop("scan")


def structure_share(spark: SparkSession, d: str) -> DataFrame:
    return fits.structure_share(*_placed(spark, d), 0.7, 1.2).select("pair", "structure_points", *[F.round(c, 9).alias(c) for c in ("matched", "near")])


STRUCTURE_SQL = f"""{PLACED}, m AS (SELECT *, scan AS pair FROM p WHERE h > 0.3::DOUBLE AND h < 2.5::DOUBLE), f AS (SELECT *, scan - 1 AS pair FROM p WHERE h > 0.3::DOUBLE AND h < 2.5::DOUBLE),
n AS (SELECT m.pair, m.pid, min(pow(m.x - f.x, 2) + pow(m.y - f.y, 2) + pow(m.z - f.z, 2)) AS d2 FROM m LEFT JOIN f ON f.pair = m.pair GROUP BY 1, 2)
SELECT pair, count(*) AS structure_points, round(count(*) FILTER (d2 < 0.49) / count(*), 9) AS matched, round(count(*) FILTER (d2 <= 1.44) / count(*), 9) AS near FROM n GROUP BY 1"""


def vertical_agreement(spark: SparkSession, d: str) -> DataFrame:
    out = fits.vertical_agreement(*_placed(spark, d), 0.9, 1.5)
    return out.select("pair", "vertical_points", F.round("agree", 9).alias("agree"), F.round("median_distance", 6).alias("median_distance"))


VERTICAL_SQL = f"""{PLACED}, m AS (SELECT *, scan AS pair FROM p WHERE abs(nz) < 0.5), n AS (SELECT m.pair, m.pid, (m.x - f.x) * (m.x - f.x) + (m.y - f.y) * (m.y - f.y) + (m.z - f.z) * (m.z - f.z) AS d2, abs(m.nx * f.nx + m.ny * f.ny + m.nz * f.nz) AS dot
FROM m JOIN p f ON f.scan = m.pair + 1 WHERE (m.x - f.x) * (m.x - f.x) + (m.y - f.y) * (m.y - f.y) + (m.z - f.z) * (m.z - f.z) <= 2.25 QUALIFY row_number() OVER (PARTITION BY m.pair, m.pid ORDER BY d2, f.pid) = 1),
k AS (SELECT pair, count(*) FILTER (d2 < 0.81 AND dot > 0.8) AS ok, median(sqrt(d2)) AS middle FROM n GROUP BY 1), a AS (SELECT pair, count(*) AS c FROM m GROUP BY 1)
SELECT a.pair, c AS vertical_points, round(coalesce(ok, 0) / c, 9) AS agree, round(middle, 6) AS median_distance FROM a LEFT JOIN k ON k.pair = a.pair"""


def plane_distances(spark: SparkSession, d: str) -> DataFrame:
    out = fits.plane_distances(*_placed(spark, d), 1.5, 0.3)
    return out.select("pair", "surface", "points", F.round("median_off", 6).alias("median_off"), F.round("close", 9).alias("close"))


PLANES_SQL = f"""{PLACED}, s AS (SELECT *, CASE WHEN h > 0.3::DOUBLE AND h < 3 THEN 'wall' WHEN abs(h) < 0.3::DOUBLE THEN 'ground' END AS surface FROM p),
n AS (SELECT m.scan AS pair, m.surface, m.pid, (m.x - f.x) * (m.x - f.x) + (m.y - f.y) * (m.y - f.y) + (m.z - f.z) * (m.z - f.z) AS d2, abs((m.x - f.x) * f.nx + (m.y - f.y) * f.ny + (m.z - f.z) * f.nz) AS off
FROM s m JOIN s f ON f.scan = m.scan + 1 AND f.surface = m.surface WHERE (m.x - f.x) * (m.x - f.x) + (m.y - f.y) * (m.y - f.y) + (m.z - f.z) * (m.z - f.z) <= 2.25 QUALIFY row_number() OVER (PARTITION BY m.scan, m.pid ORDER BY d2, f.pid) = 1)
SELECT pair, surface, count(*) AS points, round(median(off), 6) AS median_off, round(count(*) FILTER (off < 0.3::DOUBLE) / count(*), 9) AS close FROM n GROUP BY 1, 2"""

CELLS = f"""{PLACED}, a AS (SELECT scan AS pair, x, y, h, true AS m FROM p UNION ALL SELECT scan - 1, x, y, h, false FROM p), b AS (SELECT pair, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM a WHERE m GROUP BY 1),
i AS (SELECT a.pair, CAST(floor(x - x0) AS BIGINT) AS cx, CAST(floor(y - y0) AS BIGINT) AS cy, abs(h) < 0.08::DOUBLE AS gr, h > 0.3::DOUBLE AND h < 2 AS so, m, ceil(x1 - x0) + 1 AS lx, ceil(y1 - y0) + 1 AS ly FROM a JOIN b ON b.pair = a.pair),
c AS (SELECT pair, cx, cy, count(*) FILTER (gr AND NOT m) AS g, count(*) FILTER (so AND NOT m) AS o, count(*) FILTER (gr AND m) AS mg, count(*) FILTER (so AND m) AS mo, count(*) FILTER (NOT m) AS seen FROM i WHERE cx BETWEEN -1 AND lx AND cy BETWEEN -1 AND ly GROUP BY ALL),
u AS (SELECT unnest([-1, 0, 1]) AS v), k AS (SELECT q.v AS i, w.v AS j FROM u q, u w),
s AS (SELECT pair, cx + i AS cx, cy + j AS cy, max(CASE WHEN i = 0 AND j = 0 THEN g ELSE 0 END) AS g, max(CASE WHEN i = 0 AND j = 0 THEN o ELSE 0 END) AS o, max(CASE WHEN i = 0 AND j = 0 THEN mg ELSE 0 END) AS mg, max(CASE WHEN i = 0 AND j = 0 THEN mo ELSE 0 END) AS mo,
max(o) AS d_o, max(mo) AS d_mo, max(seen) AS d_seen, count(*) FILTER (abs(i) + abs(j) <= 1 AND g > 0) = 5 AS gi, count(*) FILTER (abs(i) + abs(j) <= 1 AND mg > 0) = 5 AS mgi FROM c, k WHERE abs(i) + abs(j) <= reach GROUP BY ALL)"""


def occupancy_agreement(spark: SparkSession, d: str) -> DataFrame:
    return fits.occupancy(*_placed(spark, d), 1.0, (1, 1))


OCCUPANCY_SQL = f"""{CELLS.replace('reach', '1')} SELECT pair, count(*) FILTER (mo > 0 AND d_o > 0) + count(*) FILTER (o > 0 AND d_mo > 0) AS agree, count(*) FILTER (mo > 0 AND g >= 1 AND d_o = 0) + count(*) FILTER (o > 0 AND mg >= 1 AND d_mo = 0) AS conflict FROM s GROUP BY 1"""


def cloud_consistency(spark: SparkSession, d: str) -> DataFrame:
    out = fits.consistency(*_placed(spark, d), 1.0, 12, 5)
    return out.select("pair", "agree", "conflict", "object_agree", "object_conflict", *[F.round(c, 9).alias(c) for c in ("consistency", "conflict_rate", "objects")])


CONSISTENCY_SQL = f"""{CELLS.replace('reach', '2').replace('WITH', 'WITH RECURSIVE', 1)}, n AS (SELECT pair, count(*) FILTER (mo > 0 AND d_o > 0) + count(*) FILTER (o > 0 AND d_mo > 0) AS agree, count(*) FILTER (mo > 0 AND gi AND d_o = 0) + count(*) FILTER (o > 0 AND mgi AND d_mo = 0) AS conflict, count(*) FILTER (mo > 0 AND d_seen > 0) AS inside FROM s GROUP BY 1),
e AS (SELECT pair, true AS m, cx, cy, d_o > 0 AS ok, d_o = 0 AND gi AS open FROM s WHERE mo > 0 UNION ALL SELECT pair, false, cx, cy, d_mo > 0, d_mo = 0 AND mgi FROM s WHERE o > 0),
r AS (SELECT pair, m, cx, cy, cx AS bx, cy AS b_y FROM e UNION SELECT e.pair, e.m, e.cx, e.cy, r.bx, r.b_y FROM r JOIN e ON e.pair = r.pair AND e.m = r.m AND abs(e.cx - r.cx) + abs(e.cy - r.cy) = 1),
l AS (SELECT pair, m, cx, cy, min((bx, b_y)) AS block FROM r GROUP BY 1, 2, 3, 4), j AS (SELECT e.pair, e.m, block, count(*) AS k, count(*) FILTER (ok) AS ons, count(*) FILTER (open) AS opens FROM e JOIN l USING (pair, m, cx, cy) GROUP BY 1, 2, 3 HAVING count(*) <= 12),
q AS (SELECT pair, count(*) FILTER (2 * ons >= k) AS oa, count(*) FILTER (2 * ons < k AND 2 * opens >= k) AS oc FROM j GROUP BY 1)
SELECT n.pair, agree, conflict, coalesce(oa, 0) AS object_agree, coalesce(oc, 0) AS object_conflict, round(agree / (agree + conflict), 9) AS consistency, round(CASE WHEN inside > 0 THEN least(1, conflict / inside) ELSE 0 END, 9) AS conflict_rate, round(CASE WHEN oa + oc >= 3 THEN oa / (oa + oc) END, 9) AS objects FROM n LEFT JOIN q ON q.pair = n.pair WHERE agree + conflict >= 5"""


def _site(spark: SparkSession, d: str) -> DataFrame:
    return t.points(spark, d).withColumn("h", F.abs("z"))


def _structures(spark: SparkSession, d: str) -> DataFrame:
    return scene.structures(_site(spark, d), 1.0, least=2, foot=1.0, top=1.1, wall_span=2.5, pole_cells=4)


def site_structures(spark: SparkSession, d: str) -> DataFrame:
    return _structures(spark, d).withColumn("span", F.round("span", 6))


def site_poles(spark: SparkSession, d: str) -> DataFrame:
    return scene.poles(_structures(spark, d), 1.0).select("scan", *[F.round(c, 6).alias(c) for c in "xy"])


TALL = f"""WITH RECURSIVE {t.POINTS}, c AS (SELECT scan, CAST(floor(x) AS BIGINT) AS cx, CAST(floor(y) AS BIGINT) AS cy FROM points WHERE abs(z) > 0.2::DOUBLE AND abs(z) < 8 GROUP BY ALL HAVING count(*) >= 2 AND min(abs(z)) < 1 AND max(abs(z)) > 1.1::DOUBLE),
r AS (SELECT *, cx AS bx, cy AS b_y FROM c UNION SELECT c.*, r.bx, r.b_y FROM r JOIN c ON c.scan = r.scan AND abs(c.cx - r.cx) <= 1 AND abs(c.cy - r.cy) <= 1), l AS (SELECT scan, cx, cy, min((bx, b_y)) AS b FROM r GROUP BY 1, 2, 3),
s AS (SELECT scan, cx, cy, b[1] AS bx, b[2] AS "by", count(*) OVER w AS cells, sqrt(pow(max(cx) OVER w - min(cx) OVER w, 2) + pow(max(cy) OVER w - min(cy) OVER w, 2)) AS span FROM l WINDOW w AS (PARTITION BY scan, b)),
k AS (SELECT *, CASE WHEN span >= 2.5 THEN 'wall' WHEN cells <= 4 THEN 'pole' END AS kind FROM s)"""


def kerb_steps(spark: SparkSession, d: str) -> DataFrame:
    return scene.kerbs(_site(spark, d), 0.8, 1.5, (0.1, 1.5)).withColumn("step", F.round("step", 6))


KERB_SQL = f"""{P}, g AS (SELECT scan, CAST(floor(x / 0.8::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 0.8::DOUBLE) AS BIGINT) AS cy, min(abs(z)) AS h FROM points WHERE abs(z) < 1.5 GROUP BY ALL),
s AS (SELECT a.scan, a.cx, a.cy, sqrt(pow(coalesce(e.h - a.h, 0), 2) + pow(coalesce(n.h - a.h, 0), 2)) AS step FROM g a LEFT JOIN g e ON e.scan = a.scan AND e.cx = a.cx + 1 AND e.cy = a.cy LEFT JOIN g n ON n.scan = a.scan AND n.cx = a.cx AND n.cy = a.cy + 1)
SELECT scan, cx, cy, round(step, 6) AS step FROM s WHERE step > 0.1::DOUBLE AND step < 1.5"""


def step_edges(spark: SparkSession, d: str) -> DataFrame:
    return scene.step_edges(t.points(spark, d), 1.0, (0.05, 4.0), inner=1).withColumn("slope", F.round("slope", 6))


EDGES_SQL = f"""{P}, g AS (SELECT scan, CAST(floor(x) AS BIGINT) AS cx, CAST(floor(y) AS BIGINT) AS cy, min(z) AS z FROM points GROUP BY ALL), u AS (SELECT unnest([-1, 0, 1]) AS v), k AS (SELECT q.v AS i, w.v AS j FROM u q, u w),
f AS (SELECT scan, cx - i AS cx, cy - j AS cy, median(z) AS z FROM g, k GROUP BY ALL), s AS (SELECT scan, cx - i AS cx, cy - j AS cy, count(*) AS n, sum(i * (2 - abs(j)) * z) AS gx, sum(j * (2 - abs(i)) * z) AS gy FROM f, k GROUP BY ALL HAVING count(*) = 9)
SELECT scan, cx, cy, round(sqrt(gx * gx + gy * gy) / 8, 6) AS slope FROM s WHERE sqrt(gx * gx + gy * gy) / 8 > 0.05::DOUBLE AND sqrt(gx * gx + gy * gy) / 8 < 4"""


def line_window(spark: SparkSession, d: str) -> DataFrame:
    return scene.windowed(t.points(spark, d), (0.5, -0.5), 90.0, (-1.0, 2.0), (-1.5, 1.0)).select("scan", "pid")


def edge_lines(spark: SparkSession, d: str) -> DataFrame:
    edges = scene.step_edges(t.points(spark, d), 1.0, (0.05, 4.0), inner=1)
    return scene.edge_lines(edges, 1.0, reach=0.6, draws=200, least=4, angles=(0.0, 180.0))


def level_merge(spark: SparkSession, d: str) -> DataFrame:
    points = t.points(spark, d).withColumn("site", F.col("scan") % 2)
    return placing.levelled(points, 2.0, 3).select("site", "scan", F.round("offset", 4).alias("offset"))


def _level_sql() -> str:
    """The merge of levels as one chain of tables, a scan of each site at a time (the points have ten scans)."""
    parts = [f"{P}, g AS (SELECT scan % 2 AS site, scan, floor(x / 2) AS cx, floor(y / 2) AS cy, min(z) AS z FROM points GROUP BY ALL), o AS (SELECT site, scan, row_number() OVER (PARTITION BY site ORDER BY scan) AS k FROM (SELECT DISTINCT site, scan FROM g)), n AS (SELECT g.*, k FROM g JOIN o USING (site, scan)), m1 AS (SELECT site, cx, cy, z FROM n WHERE k = 1), d1 AS (SELECT site, scan, 0.0::DOUBLE AS d FROM o WHERE k = 1)"]
    for k in range(2, 6):
        parts.append(f"s{k} AS (SELECT n.site, n.scan, list_sort(list(m.z - n.z)) AS s FROM n JOIN m{k - 1} m USING (site, cx, cy) WHERE k = {k} GROUP BY 1, 2)")
        parts.append(f"d{k} AS (SELECT o.site, o.scan, CASE WHEN len(s) >= 3 THEN s[CAST(floor(len(s) * 0.5::DOUBLE) + 1 AS BIGINT)] ELSE 0 END AS d FROM o LEFT JOIN s{k} s ON s.site = o.site AND s.scan = o.scan WHERE k = {k})")
        parts.append(f"m{k} AS (SELECT site, cx, cy, min(z) AS z FROM (SELECT * FROM m{k - 1} UNION ALL SELECT n.site, cx, cy, z + d FROM n JOIN d{k} USING (site, scan)) GROUP BY 1, 2, 3)")
    return ", ".join(parts) + " " + " UNION ALL ".join(f'SELECT site, scan, round(d, 4) AS "offset" FROM d{k}' for k in range(1, 6))


def placed_motions(spark: SparkSession, d: str) -> DataFrame:
    """Each point under its scan's motion after another, and back under the inverse of both."""
    turn = F.radians(F.col("scan") * 10.0)
    c, s, zero, one = F.cos(turn), F.sin(turn), F.lit(0.0), F.lit(1.0)
    own = F.array(c, -s, zero, F.col("scan") * 1.0, s, c, zero, F.lit(-2.0), zero, zero, one, F.lit(0.5), zero, zero, zero, one)
    both = placing.times(placing.pose([0.8, -0.6, 0, 1, 0.6, 0.8, 0, -2, 0, 0, 1, 0.5, 0, 0, 0, 1]), own)
    p = t.points(spark, d).withColumn("m", both)
    there = placing.moved(p, F.col("m")).withColumn("degrees", F.round(placing.heading(F.col("m")), 5))
    back = placing.moved(there, placing.inverse(F.col("m"))).select("pid", *[F.round(k, 5).alias(f"back_{k}") for k in "xyz"])
    return there.select("pid", "degrees", *[F.round(k, 5).alias(k) for k in "xyz"]).join(back, "pid")


MOTIONS_SQL = f"""{P}, a AS (SELECT *, radians(scan * 10.0::DOUBLE) AS r FROM points), b AS (SELECT *, cos(r) * x - sin(r) * y + scan AS u, sin(r) * x + cos(r) * y - 2 AS v FROM a), q AS (SELECT *, degrees(r) + degrees(atan2(0.6::DOUBLE, 0.8::DOUBLE)) AS g FROM b)
SELECT pid, round(CASE WHEN g > 180 THEN g - 360 ELSE g END, 5) AS degrees, round(0.8::DOUBLE * u - 0.6::DOUBLE * v + 1, 5) AS x, round(0.6::DOUBLE * u + 0.8::DOUBLE * v - 2, 5) AS y, round(z + 1, 5) AS z, round(x, 5) AS back_x, round(y, 5) AS back_y, round(z, 5) AS back_z FROM q"""


QUERIES = {
    "level_merge": (level_merge, _level_sql()),
    "placed_motions": (placed_motions, MOTIONS_SQL),
    "structure_share": (structure_share, STRUCTURE_SQL),
    "vertical_agreement": (vertical_agreement, VERTICAL_SQL),
    "plane_distances": (plane_distances, PLANES_SQL),
    "occupancy_agreement": (occupancy_agreement, OCCUPANCY_SQL),
    "cloud_consistency": (cloud_consistency, CONSISTENCY_SQL),
    "site_structures": (site_structures, f"{TALL} SELECT scan, cx, cy, bx, \"by\", cells, round(span, 6) AS span, kind FROM k"),
    "site_poles": (site_poles, f"{TALL} SELECT scan, round(avg(cx) + 0.5, 6) AS x, round(avg(cy) + 0.5, 6) AS y FROM k WHERE kind = 'pole' GROUP BY scan, bx, \"by\""),
    "kerb_steps": (kerb_steps, KERB_SQL),
    "step_edges": (step_edges, EDGES_SQL),
    "line_window": (line_window, f"{P} SELECT scan, pid FROM points WHERE y + 0.5 > -1 AND y + 0.5 < 2 AND x - 0.5 > -1.5 AND x - 0.5 < 1"),
    "edge_lines": (edge_lines, None),
}
