"""Spatial joins and text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import exposure
from . import tables as t


def _at(key: str, n: int, step: float, base: float) -> F.Column:
    return base + F.pmod(F.col(key), F.lit(n)) * step


def nearby_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer").select("c_custkey", F.substring("c_name", -1, 1).alias("street_key"), _at("c_custkey", 53, 0.0011, -37.8).alias("lat"), _at("c_custkey", 37, 0.0013, 144.9).alias("lon"))
    s = t.table(spark, d, "supplier").select("s_suppkey", _at("s_suppkey", 37, 0.0012, -37.8).alias("lat"), _at("s_suppkey", 53, 0.0011, 144.9).alias("lon"))
    pairs = exposure.nearby(c.where(exposure.within(F.col("lat"), F.col("lon"), exposure.PLAUSIBLE)), s, "s_suppkey")
    return pairs.select("c_custkey", "s_suppkey", F.round("dist_m", 3).alias("dist_m"))


NEARBY_SQL = """WITH c AS (SELECT c_custkey, -37.8 + (c_custkey % 53) * 0.0011::DOUBLE AS lat, 144.9 + (c_custkey % 37) * 0.0013::DOUBLE AS lon FROM customer),
s AS (SELECT s_suppkey, -37.8 + (s_suppkey % 37) * 0.0012::DOUBLE AS lat, 144.9 + (s_suppkey % 53) * 0.0011::DOUBLE AS lon FROM supplier),
p AS (SELECT c_custkey, s_suppkey, 2 * 6371000 * asin(sqrt(pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2))) AS dist FROM c, s WHERE abs(c.lat - s.lat) < 0.002 AND abs(c.lon - s.lon) < 0.0025)
SELECT c_custkey, s_suppkey, round(dist, 3) AS dist_m FROM p WHERE dist <= 200"""


def nearest_segment(spark: SparkSession, d: str) -> DataFrame:
    k = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("double")
    p = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (k("c_custkey", 61) * 13.7).alias("x"), (k("c_custkey", 47) * 17.3).alias("y"))
    lines = t.table(spark, d, "supplier").select("s_suppkey", F.array(F.array(k("s_suppkey", 31) * 29.1, k("s_suppkey", 23) * 31.7), F.array(k("s_suppkey", 31) * 29.1 + k("s_suppkey", 5) * 20, k("s_suppkey", 23) * 31.7 + k("s_suppkey", 3) * 25)).alias("coords"))
    return exposure.nearest_segment(p, exposure.consecutive_segments(lines), "s_suppkey", 60.0).select("id", "s_suppkey", F.round("dist_m", 3).alias("dist_m"))


SEGMENT_SQL = """WITH p AS (SELECT c_custkey AS id, (c_custkey % 61) * 13.7::DOUBLE AS x, (c_custkey % 47) * 17.3::DOUBLE AS y FROM customer),
s AS (SELECT s_suppkey, (s_suppkey % 31) * 29.1::DOUBLE AS ax, (s_suppkey % 23) * 31.7::DOUBLE AS ay, (s_suppkey % 31) * 29.1::DOUBLE + (s_suppkey % 5) * 20 AS bx, (s_suppkey % 23) * 31.7::DOUBLE + (s_suppkey % 3) * 25 AS cy FROM supplier),
t AS (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (cy - ay)) / CASE WHEN (bx - ax) * (bx - ax) + (cy - ay) * (cy - ay) = 0 THEN 1e-9 ELSE (bx - ax) * (bx - ax) + (cy - ay) * (cy - ay) END)) AS u FROM p, s),
q AS (SELECT id, s_suppkey, sqrt(pow(ax + u * (bx - ax) - x, 2) + pow(ay + u * (cy - ay) - y, 2)) AS dist FROM t)
SELECT id, s_suppkey, round(dist, 3) AS dist_m FROM q WHERE dist <= 60 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, s_suppkey) = 1"""


def projections(spark: SparkSession, d: str) -> DataFrame:
    """Round trips of both projections: errors in metres stay at 0."""
    c = t.table(spark, d, "customer").select("c_custkey", _at("c_custkey", 53, 0.031, -38.4).alias("lat"), _at("c_custkey", 37, 0.11, 143.1).alias("lon"))
    x, y = geo.conic(F.col("lat"), F.col("lon"))
    la, lo = geo.conic_inverse(F.col("x"), F.col("y"))
    e, n = geo.utm(F.col("lat"), F.col("lon"), 55)
    la2, lo2 = geo.utm_inverse(F.col("e"), F.col("n"), 55)
    m = lambda a, b: F.round(F.abs(geo.flat_distance_m(a, b, F.col("lat"), F.col("lon"))), 2)
    c = c.withColumns({"x": x, "y": y, "e": e, "n": n})
    return c.select("c_custkey", m(la, lo).alias("conic_error_m"), m(la2, lo2).alias("utm_error_m"))


def bearings(spark: SparkSession, d: str) -> DataFrame:
    dx, dy = F.pmod("c_custkey", F.lit(7)).cast("double") - 3.25, F.pmod("c_custkey", F.lit(11)).cast("double") - 5.5
    c = t.table(spark, d, "customer").withColumns({"dx": dx, "dy": dy})
    along, off = geo.along_and_off(F.col("dx"), F.col("dy"), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0))
    return c.select("c_custkey", geo.compass(F.col("dx"), F.col("dy")).alias("side"), F.round(geo.angle_between(F.degrees(F.atan2("dx", "dy")), F.lit(350.0)), 6).alias("off_north"), F.round(along, 6).alias("along"), F.round(off, 6).alias("off"))


BEARINGS_SQL = """WITH c AS (SELECT c_custkey, CAST(c_custkey % 7 AS DOUBLE) - 3.25::DOUBLE AS dx, CAST(c_custkey % 11 AS DOUBLE) - 5.5::DOUBLE AS dy FROM customer),
b AS (SELECT *, degrees(atan2(dx, dy)) AS deg, degrees(atan2(dx, dy)) - 350 - 360 * floor((degrees(atan2(dx, dy)) - 350) / 360) AS m FROM c)
SELECT c_custkey, CASE WHEN deg >= -45 AND deg < 45 THEN 'N' WHEN deg >= 45 AND deg < 135 THEN 'E' WHEN deg >= -135 AND deg < -45 THEN 'W' ELSE 'S' END AS side, round(least(m, 360 - m), 6) AS off_north, round((3 * dx + 4 * dy) / 5, 6) AS along, round((3 * dy - 4 * dx) / 5, 6) AS "off" FROM b"""


NOTICE = ["Impact to traffic will be {} lanes closed northbound. ", "The road will be closed. ", "Impact to traffic will be on-ramp closed. ", "No traffic change. "]


def _notices(spark: SparkSession, d: str) -> DataFrame:
    """Orders as notices with a text built from their fields."""
    o = F.col("o_orderkey")
    hours = F.element_at(F.array(*[F.lit(x) for x in ("Weekdays 8:00 PM to 5:30 AM", "Weekends 12:00 AM to 12:00 AM", "Weekdays 9:30 AM to 3:00 PM", "Weekdays 12:30 AM to 4:00 AM", "any time")]), (F.pmod(o, F.lit(5)) + 1).cast("int"))
    body = F.element_at(F.array(F.lit("Impact to traffic will be lanes closed northbound. "), F.lit("The road will be closed. "), F.lit("Impact to traffic will be on-ramp closed. "), F.lit("No traffic change. ")), (F.pmod(o, F.lit(4)) + 1).cast("int"))
    return t.table(spark, d, "orders").select(o, F.concat(F.lit("Works during the following times: "), hours, F.lit(". "), body).alias("description"))


NOTICES = "n AS (SELECT o_orderkey, 'Works during the following times: ' || ['Weekdays 8:00 PM to 5:30 AM', 'Weekends 12:00 AM to 12:00 AM', 'Weekdays 9:30 AM to 3:00 PM', 'Weekdays 12:30 AM to 4:00 AM', 'any time'][CAST(o_orderkey % 5 + 1 AS INTEGER)] || '. ' || ['Impact to traffic will be lanes closed northbound. ', 'The road will be closed. ', 'Impact to traffic will be on-ramp closed. ', 'No traffic change. '][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS description FROM orders)"


def text_first_match_class(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("description")
    return _notices(spark, d).select("o_orderkey", text.closure_type(x).alias("closure_type"), text.work_window(x).alias("work_window"), text.capture(x, text.IMPACT_TEXT).alias("impact_text"), text.capture(x, text.WORK_TIMES_TEXT).alias("work_times_text"))


def _case(column: str, patterns: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for p, n in patterns) + " ELSE 'unspecified' END"


CLASS_SQL = f"""WITH {NOTICES} SELECT o_orderkey, {_case('lower(description)', text.CLOSURE_PATTERNS)} AS closure_type, {_case('description', text.WINDOW_PATTERNS)} AS work_window,
CASE WHEN regexp_matches(description, '{text.IMPACT_TEXT}') THEN regexp_extract(description, '{text.IMPACT_TEXT}', 1) END AS impact_text,
CASE WHEN regexp_matches(description, '{text.WORK_TIMES_TEXT}') THEN regexp_extract(description, '{text.WORK_TIMES_TEXT}', 1) END AS work_times_text FROM n"""


def street_key_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Part names dressed as street names."""
    kind = F.element_at(F.array(*[F.lit(x) for x in (" Street", " RD", " Avenue - Carlton", " Pde North", " Way", "")]), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int"))
    p = t.table(spark, d, "part").select("p_partkey", F.concat("p_name", kind).alias("name"), "p_name")
    key = text.street_key(F.col("name"))
    return p.select("p_partkey", key.alias("street_key"), text.bare_name(F.col("name")).alias("bare_name"), text.name_in(key, F.col("p_name")).alias("same_street"))


STREET_SQL = rf"""WITH p AS (SELECT p_partkey, p_name, p_name || [' Street', ' RD', ' Avenue - Carlton', ' Pde North', ' Way', ''][CAST(p_partkey % 6 + 1 AS INTEGER)] AS name FROM part),
k AS (SELECT *, trim(regexp_replace(regexp_replace(upper(name), '\s*-\s.*$', ''), '\s+({text.ROAD_TYPES})\b.*$', '')) AS street_key FROM p)
SELECT p_partkey, street_key, regexp_replace(regexp_replace(upper(name), '\b({text.NAME_WORDS})\b\.?', '', 'g'), '[^A-Z]', '', 'g') AS bare_name, length(street_key) >= 3 AND contains(upper(p_name), street_key) AS same_street FROM k"""


def cross_street_match(spark: SparkSession, d: str) -> DataFrame:
    """A street and the first cross street of an extent against site names A/B; the first site in order wins."""
    names = F.array(*[F.lit(x) for x in ("Swan St", "Bridge Rd", "Church Street", "High", "Peel St")])
    at = lambda c, n: F.element_at(names, (F.pmod(F.floor(F.col(c) / n), F.lit(5)) + 1).cast("int"))
    sites = t.table(spark, d, "supplier").select("s_suppkey", F.concat(F.upper(at("s_suppkey", 1)), F.lit("/"), F.upper(at("s_suppkey", 5))).alias("name"))
    parts = sites.select("s_suppkey", F.transform(F.split("name", "/"), text.bare_name).alias("parts"))
    main = text.bare_name(F.col("street"))
    plans = t.table(spark, d, "customer").select("c_custkey", at("c_custkey", 1).alias("street"), F.concat(F.lit("between "), at("c_custkey", 5), F.lit(" and "), at("c_custkey", 25)).alias("extent"))
    asked = plans.select("c_custkey", main.alias("main"), F.posexplode(text.cross_streets(F.col("extent"), main)).alias("pos", "cross"))
    by_name = parts.select("s_suppkey", "parts", F.explode(F.array_distinct("parts")).alias("main"))
    met = asked.join(F.broadcast(by_name.groupBy("main", "parts").agg(F.min("s_suppkey").alias("s_suppkey"))), "main").where(F.array_contains("parts", F.col("cross")))  # 25 names at most
    return met.groupBy("c_custkey").agg(F.min(F.struct("pos", "s_suppkey")).alias("m")).select("c_custkey", F.col("m.pos").alias("pos"), F.col("m.s_suppkey").alias("s_suppkey"))


NAMES = "['SWAN', 'BRIDGE', 'CHURCH', 'HIGH', 'PEEL']"
CROSS_SQL = f"""WITH s AS (SELECT s_suppkey, {NAMES}[CAST(s_suppkey % 5 + 1 AS INTEGER)] AS a, {NAMES}[CAST(s_suppkey // 5 % 5 + 1 AS INTEGER)] AS b FROM supplier),
p AS (SELECT c_custkey, {NAMES}[CAST(c_custkey % 5 + 1 AS INTEGER)] AS main, list_filter([{NAMES}[CAST(c_custkey // 5 % 5 + 1 AS INTEGER)], {NAMES}[CAST(c_custkey // 25 % 5 + 1 AS INTEGER)]], lambda x: x <> {NAMES}[CAST(c_custkey % 5 + 1 AS INTEGER)]) AS crosses FROM customer),
q AS (SELECT c_custkey, main, unnest(crosses) AS cross_name, generate_subscripts(crosses, 1) - 1 AS pos FROM p)
SELECT c_custkey, CAST(pos AS INTEGER) AS pos, s_suppkey FROM q JOIN s ON (main = a OR main = b) AND (cross_name = a OR cross_name = b) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY pos, s_suppkey) = 1"""


def work_hours_read(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(*[F.lit(x) for x in ("7am to 3:30 pm Mon to Fri", "2200 to 0500", "9pm-12am weekdays", "07:00 - 17:00 Sat", "12 am to 11 am", "no times")])
    o = t.table(spark, d, "orders").select("o_orderkey", F.element_at(forms, (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int")).alias("txt"), F.when(F.pmod("o_orderkey", F.lit(4)) == 0, "10 pm").alias("s"), F.when(F.pmod("o_orderkey", F.lit(8)) == 0, "5:00").alias("e"))
    h = text.work_hours(F.col("txt"), F.col("s"), F.col("e"))
    out = o.select("o_orderkey", h.alias("h"), text.work_days(F.lit(""), F.col("txt")).alias("days"))
    return out.groupBy("h.start_hour", "h.end_hour", "days").agg(F.count("*").alias("n")).select("start_hour", "end_hour", "days", text.hour_label(F.col("start_hour")).alias("start_label"), text.about(F.col("n").cast("double")).alias("about"), "n")


HOURS_SQL = """WITH o AS (SELECT o_orderkey % 6 AS f, o_orderkey % 4 = 0 AS s, o_orderkey % 8 = 0 AS e FROM orders),
f(f, a, b, days) AS (VALUES (0, 7, 15, 'Mon to Fri'), (1, 22, 5, ''), (2, 21, 24, ''), (3, 7, 17, 'Sat'), (4, 0, 11, ''), (5, NULL, NULL, '')),
x AS (SELECT CAST(CASE WHEN o.s AND (o.e OR f.a IS NULL) THEN 22 ELSE f.a END AS INTEGER) AS start_hour, CAST(CASE WHEN o.e AND (o.s OR f.a IS NULL) THEN 5 ELSE f.b END AS INTEGER) AS end_hour, f.days AS days FROM o JOIN f ON o.f = f.f),
g AS (SELECT start_hour, end_hour, days, count(*) AS n FROM x GROUP BY 1, 2, 3)
SELECT start_hour, end_hour, days, CASE WHEN start_hour IN (0, 24) THEN 'midnight' WHEN start_hour = 12 THEN 'noon' WHEN start_hour < 12 THEN start_hour || 'am' ELSE (start_hour - 12) || 'pm' END AS start_label, format('{:,}', CASE WHEN n >= 1000 THEN CAST(floor(n / 100 + 0.5) * 100 AS BIGINT) WHEN n >= 100 THEN CAST(floor(n / 10 + 0.5) * 10 AS BIGINT) ELSE n END) AS about, n FROM g"""


def json_access(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").select("event_type", F.from_json("props", "k long, nested struct<a: string>").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("p.k").alias("n_k"), F.count("p.nested.a").alias("n_nested"), F.count("*").alias("n"))


def projected(spark: SparkSession, d: str) -> DataFrame:
    """Customers' places on both grids."""
    c = t.table(spark, d, "customer").select("c_custkey", (-38 + F.col("c_custkey") % 997 / 500).alias("lat"), (146 + F.col("c_custkey") % 991 / 500).alias("lon"))
    x, y = geo.conic(F.col("lat"), F.col("lon"))
    e, n = geo.utm(F.col("lat"), F.col("lon"), 55)
    return c.select("c_custkey", *[F.round(v, places).alias(k) for k, v, places in (("x", x, 2), ("y", y, 2), ("east", e, 2), ("north", n, 0))])


#: Snyder's series in powers of the longitude for the transverse Mercator, and his conic formulas: other ones than the library's.
PROJECTED_SQL = """WITH k AS (SELECT 6378137.0::DOUBLE AS a, (2 - 1 / 298.257222101::DOUBLE) / 298.257222101::DOUBLE AS e2),
p AS (SELECT c_custkey, radians(-38 + c_custkey % 997 / 500::DOUBLE) AS la, radians(146 + c_custkey % 991 / 500::DOUBLE) AS lo FROM customer),
u AS (SELECT p.*, a, e2, e2 / (1 - e2) AS q, a / sqrt(1 - e2 * sin(la) ** 2) AS n, tan(la) ** 2 AS t, e2 / (1 - e2) * cos(la) ** 2 AS c, (lo - radians(147)) * cos(la) AS w,
a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256 - 175 * e2 ** 4 / 16384) * la - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024 + 105 * e2 ** 4 / 4096) * sin(2 * la) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024 + 525 * e2 ** 4 / 16384) * sin(4 * la) - (35 * e2 ** 3 / 3072 + 175 * e2 ** 4 / 12288) * sin(6 * la) + 315 * e2 ** 4 / 131072 * sin(8 * la)) AS m FROM p, k),
m AS (SELECT *, cos(f) / sqrt(1 - e2 * sin(f) ** 2) AS mm, tan(pi() / 4 - f / 2) / ((1 - sqrt(e2) * sin(f)) / (1 + sqrt(e2) * sin(f))) ** (sqrt(e2) / 2) AS tt FROM (SELECT radians(unnest([-36, -38, -37])::DOUBLE) AS f, unnest([1, 2, 0]) AS i), k),
v AS (SELECT (ln(m1.mm) - ln(m2.mm)) / (ln(m1.tt) - ln(m2.tt)) AS nn, m1.mm AS m1, m1.tt AS t1, m0.tt AS t0 FROM m m1, m m2, m m0 WHERE m1.i = 1 AND m2.i = 2 AND m0.i = 0),
g AS (SELECT u.*, nn, a * m1 / (nn * t1 ** nn) * (tan(pi() / 4 - la / 2) / ((1 - sqrt(e2) * sin(la)) / (1 + sqrt(e2) * sin(la))) ** (sqrt(e2) / 2)) ** nn AS rho, a * m1 / (nn * t1 ** nn) * t0 ** nn AS rho0 FROM u, v)
SELECT c_custkey, round(2500000 + rho * sin(nn * (lo - radians(145))), 2) AS x, round(2500000 + rho0 - rho * cos(nn * (lo - radians(145))), 2) AS y,
round(500000 + 0.9996::DOUBLE * n * (w + (1 - t + c) * w ** 3 / 6 + (5 - 18 * t + t ** 2 + 72 * c - 58 * q) * w ** 5 / 120 + (61 - 479 * t + 179 * t ** 2 - t ** 3) * w ** 7 / 5040), 2) AS east,
round(10000000 + 0.9996::DOUBLE * (m + n * tan(la) * (w ** 2 / 2 + (5 - t + 9 * c + 4 * c ** 2) * w ** 4 / 24 + (61 - 58 * t + t ** 2 + 600 * c - 330 * q) * w ** 6 / 720 + (1385 - 3111 * t + 543 * t ** 2 - t ** 3) * w ** 8 / 40320)), 0) AS north FROM g"""


QUERIES = {
    "projected_points": (projected, PROJECTED_SQL),
    "nearby_pairs": (nearby_pairs, NEARBY_SQL),
    "nearest_segment": (nearest_segment, SEGMENT_SQL),
    "projection_round_trips": (projections, "SELECT c_custkey, 0.0::DOUBLE AS conic_error_m, 0.0::DOUBLE AS utm_error_m FROM customer"),
    "bearings_and_offsets": (bearings, BEARINGS_SQL),
    "text_first_match_class": (text_first_match_class, CLASS_SQL),
    "street_key_normalise": (street_key_normalise, STREET_SQL),
    "cross_street_match": (cross_street_match, CROSS_SQL),
    "work_hours_read": (work_hours_read, HOURS_SQL),
    "json_access": (json_access, "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract_string(props, '$.k')) AS n_k, 0::BIGINT AS n_nested, count(*) AS n FROM events GROUP BY 1"),
}
