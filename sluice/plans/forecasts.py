"""Queue forecasts and severity ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import queue, rating
from . import tables as t


def _profile(spark: SparkSession, d: str) -> DataFrame:
    """Share of the day's events by hour: 24 rows."""
    e = t.table(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.sum("value").alias("v"))
    total = e.agg(F.sum("v").alias("total"))
    return e.crossJoin(F.broadcast(total)).select("hour", F.round(F.col("v") / F.col("total"), 9).alias("share"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Customers as closures in three windows each."""
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("request"), (20000 + F.pmod("c_custkey", F.lit(37)) * 1500).cast("double").alias("aadt"), (2 + F.pmod("c_custkey", F.lit(2))).cast("int").alias("lanes_per_direction"), F.pmod("c_custkey", F.lit(3)).cast("int").alias("lanes_open"), (F.lit(-0.2) + F.pmod("c_custkey", F.lit(5)) * 0.02).alias("p50"), (F.lit(-0.02) + F.pmod("c_custkey", F.lit(4)) * 0.03).alias("p90"))
    c = c.withColumn("work_window", F.explode(F.array(F.lit("night"), F.lit("day"), F.lit("24 hours"))))
    return c.withColumn("active", queue.window_hours(F.col("work_window")))


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    hours = queue.scenarios(queue.hourly(_requests(spark, d), _profile(spark, d)))
    return queue.fold(hours, ["request", "work_window", "scenario"])


def queue_fold(spark: SparkSession, d: str) -> DataFrame:
    return _summaries(spark, d).withColumn("delay_veh_h", F.round("delay_veh_h", 3))


HOURS = """e AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, sum(value) AS v FROM events GROUP BY 1), pr AS (SELECT hour, round(v / sum(v) OVER (), 9) AS share FROM e),
w(work_window, active) AS (VALUES ('night', [20,21,22,23,0,1,2,3,4]), ('day', [9,10,11,12,13,14]), ('24 hours', range(24))),
rq AS (SELECT c_custkey AS request, 20000 + (c_custkey % 37) * 1500 AS aadt, 2 + c_custkey % 2 AS lpd, c_custkey % 3 AS lo, s.scenario, CASE s.scenario WHEN 'typical' THEN -0.2::DOUBLE + (c_custkey % 5) * 0.02::DOUBLE ELSE -0.02::DOUBLE + (c_custkey % 4) * 0.03::DOUBLE END AS change, work_window, active FROM customer, w, (SELECT unnest(['typical', 'worst']) AS scenario) s),
hr AS (SELECT request, work_window, scenario, lo, (hour - 5 + 24) % 24 AS i, aadt * 0.5::DOUBLE * share * (1 + CASE WHEN list_contains(active, hour) THEN change ELSE 0 END) AS dm, CASE WHEN list_contains(active, hour) THEN lo * 800 * 0.85::DOUBLE ELSE lpd * 800 END AS cap, 500 / 7.0::DOUBLE * greatest(lo, 1) AS qmax FROM rq, pr),
f AS (SELECT request, work_window, scenario, i, lo, greatest(0, dm - cap) AS raw, qmax, least(greatest(0, dm - cap), qmax) AS q, 0.0::DOUBLE AS before FROM hr WHERE i = 0
UNION ALL SELECT h.request, h.work_window, h.scenario, h.i, h.lo, greatest(0, f.q + h.dm - h.cap), h.qmax, least(greatest(0, f.q + h.dm - h.cap), h.qmax), f.q FROM f JOIN hr h ON h.request = f.request AND h.work_window = f.work_window AND h.scenario = f.scenario AND h.i = f.i + 1),
s AS (SELECT request, work_window, scenario, sum((before + q) / 2) AS delay_veh_h, CAST(round_even(max(round_even(q, 0)) * 7 / greatest(any_value(lo), 1), 0) AS BIGINT) AS max_queue_m, count(CASE WHEN round_even(q, 0) > 0 THEN 1 END) AS queue_hours, CAST(sum(round_even(raw - q, 0)) AS BIGINT) AS forced_diversions_veh FROM f GROUP BY 1, 2, 3)"""
FOLD_SQL = f"WITH RECURSIVE {HOURS} SELECT request, work_window, scenario, round(delay_veh_h, 3) AS delay_veh_h, max_queue_m, queue_hours, forced_diversions_veh FROM s"


def compare_windows(spark: SparkSession, d: str) -> DataFrame:
    worst = _summaries(spark, d).where("scenario = 'worst'").withColumn("delay_veh_h", F.round("delay_veh_h", 3))
    return queue.best_window(worst, "request").select("request", "work_window", "delay_veh_h", F.col("rank").cast("long").alias("rank"), "recommended")


COMPARE_SQL = f"WITH RECURSIVE {HOURS}, x AS (SELECT request, work_window, round(delay_veh_h, 3) AS delay_veh_h FROM s WHERE scenario = 'worst') SELECT *, row_number() OVER (PARTITION BY request ORDER BY delay_veh_h, CASE work_window WHEN 'night' THEN 0 WHEN 'day' THEN 1 ELSE 2 END) AS rank, row_number() OVER (PARTITION BY request ORDER BY delay_veh_h, CASE work_window WHEN 'night' THEN 0 WHEN 'day' THEN 1 ELSE 2 END) = 1 AS recommended FROM x"


def plan_window_jaccard(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.calendar import hours_between

    o = t.table(spark, d, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(24)).cast("int").alias("start"), F.pmod("o_custkey", F.lit(24)).cast("int").alias("end"))
    h = o.withColumn("hours", hours_between(F.col("start"), F.col("end")))
    return h.select("o_orderkey", F.size("hours").cast("long").alias("n_hours"), queue.nearest_window(F.col("hours")).alias("window"))


JACCARD_SQL = """WITH o AS (SELECT o_orderkey, o_orderkey % 24 AS s, o_custkey % 24 AS e FROM orders),
h AS (SELECT o_orderkey, list_filter(range(24), lambda x: CASE WHEN e > s THEN x >= s AND x < e ELSE x >= s OR x < e END) AS hours FROM o),
w(k, name, win) AS (VALUES (0, 'night', [20,21,22,23,0,1,2,3,4]), (1, 'day', [9,10,11,12,13,14]), (2, '24 hours', range(24)))
SELECT o_orderkey, CAST(len(hours) AS BIGINT) AS n_hours, name AS "window" FROM h, w QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY len(list_intersect(hours, win)) / len(list_distinct(list_concat(hours, win))) DESC, k) = 1"""


def _values(spark: SparkSession, d: str) -> DataFrame:
    """Some modes have only a metric that their rule does not list; some transport has only diversions, of 0 or more."""
    k = F.col("c_custkey")
    v = [("cars", "forced_diversions", F.pmod(k * 37, F.lit(1500))), ("cars", "max_queue", F.pmod(k * 11, F.lit(300))), ("cars", "delay", F.pmod(k * 7, F.lit(260))), ("trucks", "forced_diversions", F.pmod(k * 5, F.lit(130))), ("trucks", "max_queue", F.pmod(k * 3, F.lit(60))), ("public_transport", "delay", F.pmod(k * 13, F.lit(210))), ("public_transport", "forced_diversions", F.pmod(k, F.lit(9)) - 6), ("pedestrians", "detour", F.pmod(k * 17, F.lit(140))), ("pedestrians", "delay", F.pmod(k, F.lit(50)))]
    shown = {("public_transport", "delay"): F.pmod(k, F.lit(3)) == 0, ("public_transport", "forced_diversions"): F.pmod(k, F.lit(9)) > 5, ("pedestrians", "delay"): F.pmod(k, F.lit(6)) == 5, "pedestrians": F.pmod(k, F.lit(2)) == 0, "trucks": F.pmod(k, F.lit(5)) != 0}
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(x).alias("metric"), F.when(shown.get((m, x), shown.get(m, F.lit(True))), e.cast("double")).alias("value")) for m, x, e in v])
    return t.table(spark, d, "customer").select(k.alias("request"), F.inline(rows)).where("value is not null")


def severity_modes(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer")
    k = F.col("c_custkey")
    rated = rating.rate_metrics(_values(spark, d))
    plans = c.select(k.alias("request"), (F.pmod(k, F.lit(4)) == 1).alias("tram"), (F.pmod(k, F.lit(7)) == 1).alias("moves_people"), F.when(F.pmod(k, F.lit(10)) == 0, "road closed").otherwise("lanes closed").alias("closure_type"))
    return rating.all_modes(plans, rated)


VALUES = """v AS (SELECT c_custkey AS request, unnest([{'mode': 'cars', 'metric': 'forced_diversions', 'o': 0, 'value': c_custkey * 37 % 1500, 'h': 1000, 'm': 100}, {'mode': 'cars', 'metric': 'max_queue', 'o': 1, 'value': c_custkey * 11 % 300, 'h': 250, 'm': 50}, {'mode': 'cars', 'metric': 'delay', 'o': 2, 'value': c_custkey * 7 % 260, 'h': 200, 'm': 20},
{'mode': 'trucks', 'metric': 'forced_diversions', 'o': 0, 'value': CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 5 % 130 END, 'h': 1000, 'm': 100}, {'mode': 'trucks', 'metric': 'max_queue', 'o': 1, 'value': CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 3 % 60 END, 'h': 250, 'm': 50},
{'mode': 'public_transport', 'metric': 'delay', 'o': 0, 'value': CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 13 % 210 END, 'h': 200, 'm': 20}, {'mode': 'public_transport', 'metric': 'forced_diversions', 'o': 99, 'value': CASE WHEN c_custkey % 9 > 5 THEN c_custkey % 9 - 6 END, 'h': NULL, 'm': NULL},
{'mode': 'pedestrians', 'metric': 'detour', 'o': 0, 'value': CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 17 % 140 END, 'h': 100, 'm': 30}, {'mode': 'pedestrians', 'metric': 'delay', 'o': 99, 'value': CASE WHEN c_custkey % 6 = 5 THEN c_custkey % 50 END, 'h': NULL, 'm': NULL}], recursive := true) FROM customer),
l AS (SELECT request, mode, metric, o, CASE WHEN value >= h THEN 3 WHEN value >= m THEN 2 ELSE 1 END AS lv FROM v WHERE value IS NOT NULL),
b AS (SELECT request, mode, CASE WHEN mode = 'public_transport' AND request % 9 > 6 THEN 3 ELSE lv END AS lv, CASE WHEN mode = 'public_transport' AND request % 9 > 6 THEN 'forced_diversions' WHEN lv > 1 THEN metric END AS metric FROM l QUALIFY row_number() OVER (PARTITION BY request, mode ORDER BY lv DESC, o) = 1),
am AS (SELECT c_custkey AS request, mode, k FROM customer, (VALUES ('cars', 0), ('pedestrians', 1), ('public_transport', 2), ('trucks', 3)) x(mode, k)),
r AS (SELECT am.request, am.mode, am.k, CASE b.lv WHEN 3 THEN 'High' WHEN 2 THEN 'Moderate' WHEN 1 THEN 'Low' ELSE CASE WHEN (am.mode = 'public_transport' AND am.request % 4 = 1) OR (am.mode = 'pedestrians' AND am.request % 7 = 1) OR (am.mode = 'trucks' AND am.request % 10 = 0) THEN 'Review required' ELSE 'Not modelled' END END AS severity, b.metric FROM am LEFT JOIN b ON b.request = am.request AND b.mode = am.mode)"""


def severity_rating(spark: SparkSession, d: str) -> DataFrame:
    return rating.overall(severity_modes(spark, d))


OVERALL_SQL = f"WITH {VALUES} SELECT request, mode, CASE severity WHEN 'Review required' THEN 'Moderate' ELSE severity END AS overall FROM r QUALIFY row_number() OVER (PARTITION BY request ORDER BY CASE severity WHEN 'High' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Review required' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END DESC, k) = 1"


def footpath_check(spark: SparkSession, d: str) -> DataFrame:
    s = t.table(spark, d, "part").select(F.col("p_brand").alias("site"), F.when(F.pmod("p_partkey", F.lit(11)) > 0, F.round(1.1 + F.pmod("p_partkey", F.lit(13)) * 0.06, 2)).alias("min_clear_m"), F.pmod("p_partkey", F.lit(40)).cast("double").alias("ppm"))
    out = rating.footpath_check(s)
    g = s.where("min_clear_m is not null").groupBy("site").agg(F.max(rating.crowding_grade(F.col("ppm"), F.col("min_clear_m"))).alias("worst_grade"), F.round(F.max(rating.required_width(F.col("ppm"))), 6).alias("required_m"))
    return out.join(g, "site", "left")


FOOTPATH_SQL = """WITH s AS (SELECT p_brand AS site, CASE WHEN p_partkey % 11 > 0 THEN round(1.1::DOUBLE + (p_partkey % 13) * 0.06::DOUBLE, 2) END AS w, CAST(p_partkey % 40 AS DOUBLE) AS ppm FROM part),
g AS (SELECT *, floor(ppm / (w - 0.4::DOUBLE) + 0.5) AS f FROM s),
h AS (SELECT *, CASE WHEN w IS NULL THEN NULL WHEN f < 3 THEN 'A+' WHEN f < 6 THEN 'A' WHEN f < 9 THEN 'A-' WHEN f < 12 THEN 'B+' WHEN f < 15 THEN 'B' WHEN f < 18 THEN 'B-' WHEN f < 21 THEN 'C+' WHEN f < 24 THEN 'C' WHEN f < 27 THEN 'C-' WHEN f < 36 THEN 'D' ELSE 'E' END AS grade FROM g)
SELECT site, min(w) AS narrowest_m, count(CASE WHEN w < 1.5 THEN 1 END) AS n_conflicts, CASE WHEN min(w) IS NULL THEN 'Moderate' WHEN min(w) < 1.2 THEN 'High' WHEN count(CASE WHEN w < 1.5 THEN 1 END) > 0 THEN 'Moderate' ELSE 'Low' END AS severity, max(grade) AS worst_grade, round(max(CASE WHEN w IS NOT NULL THEN ppm / 11 + 0.4::DOUBLE END), 6) AS required_m FROM h GROUP BY 1"""


def round_robin_top5(spark: SparkSession, d: str) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in rating.ORDER]), (F.pmod("p_size", F.lit(5)) + 1).cast("int"))
    a = t.table(spark, d, "part").select(F.col("p_brand").alias("site"), F.col("p_type").alias("category"), level.alias("severity"), F.col("p_partkey").alias("position"))
    return rating.recommendations(a).select("site", F.col("id").cast("long").alias("id"), "category", "severity", "position")


ROBIN_SQL = """WITH a AS (SELECT p_brand AS site, p_type AS category, ['High', 'Moderate', 'Review required', 'Low', 'Not modelled'][CAST(p_size % 5 + 1 AS INTEGER)] AS severity, p_size % 5 AS lv, p_partkey AS position FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY site, category ORDER BY lv, position) = 1 AS f FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CAST(f AS INTEGER) DESC, lv, position) AS id FROM b) SELECT site, id, category, severity, position FROM c WHERE id <= 5"""


def lanes_and_spread(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(x) for x in ("road closed", "lanes closed", "footpath only", "unspecified")])
    p = t.table(spark, d, "part").select("p_partkey", F.element_at(kinds, (F.pmod(k, F.lit(4)) + 1).cast("int")).alias("closure_type"), (F.pmod(k, F.lit(3)) == 0).alias("direction_closed"), F.pmod(k, F.lit(5)).cast("int").alias("lanes_per_direction"), F.pmod(k, F.lit(7)).cast("int").alias("lanes_open"), "p_retailprice", "p_size")
    s = queue.spread(F.col("p_retailprice") * 0.7, F.col("p_retailprice") * 0.5, F.col("p_retailprice") * 0.9)
    return queue.lanes(p).select("p_partkey", "lanes_per_direction", "lanes_open", queue.confidence(F.pmod(k, F.lit(3)) + 1, F.col("lanes_open")).alias("confidence"), s["low"].alias("low"), s["typical"].alias("typical"), s["high"].alias("high"), queue.modelled_aadt(F.when(F.pmod(k, F.lit(2)) == 0, F.col("p_size").cast("double") * 100)).alias("aadt"))


LANES_SQL = """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS t, p_partkey % 3 = 0 AS dc, p_partkey % 5 AS per, p_partkey % 7 AS op, p_retailprice AS r, p_size FROM part),
q AS (SELECT *, t <> 0 AND t <> 2 AND NOT dc AS partial FROM p), l AS (SELECT *, CASE WHEN per < 1 THEN CASE WHEN partial THEN 2 ELSE 1 END ELSE per END AS per2 FROM q),
m AS (SELECT *, CASE WHEN t = 0 OR (t <> 2 AND dc) THEN 0 WHEN t = 2 THEN per2 ELSE least(op, per2) END AS o1 FROM l), n AS (SELECT *, CASE WHEN partial AND o1 < 1 THEN greatest(1, per2 - 1) ELSE o1 END AS o2 FROM m)
SELECT k AS p_partkey, CAST(per2 AS INTEGER) AS lanes_per_direction, CAST(o2 AS INTEGER) AS lanes_open, CASE WHEN k % 3 = 0 AND o2 > 0 THEN 'medium' ELSE 'low' END AS confidence, CAST(floor(r * 0.5::DOUBLE + 0.5) AS BIGINT) AS low, CAST(floor(r * 0.5::DOUBLE + 0.5) AS BIGINT) AS typical, CAST(floor(r * 0.9::DOUBLE + 0.5) AS BIGINT) AS high, CASE WHEN k % 2 = 0 AND p_size <> 0 THEN p_size * 100 * 0.5::DOUBLE ELSE 20000.0 END AS aadt FROM n"""


def weekday_peak(spark: SparkSession, d: str) -> DataFrame:
    """Mean weekday volume by hour per site, rounded, and the first busiest hour from 7 to 18."""
    h = t.site_hours(spark, d).where("weekday(day) < 5").groupBy("site", "hour").agg(text.round_up_half(F.avg("volume")).alias("people"))
    top = h.where("hour between 7 and 18").groupBy("site").agg(F.max(F.struct("people", (-F.col("hour")).alias("h"))).alias("t"))
    return top.select("site", (-F.col("t.h")).alias("hour"), F.col("t.people").alias("people_per_hour"), (text.round_up_half(F.col("t.people") / 6) / 10).alias("people_per_minute"), text.percent(F.col("t.people") / 1000).alias("label"))


PEAK_SQL = f"WITH {t.SITE_HOURS}, h AS (SELECT site, hour, CAST(floor(avg(volume) + 0.5) AS BIGINT) AS people FROM site_hours WHERE isodow(day) < 6 GROUP BY 1, 2) SELECT site, hour, people AS people_per_hour, floor(people / 6 + 0.5) / 10 AS people_per_minute, CAST(floor(people / 1000 * 100 + 0.5) AS BIGINT) || '%' AS label FROM h WHERE hour BETWEEN 7 AND 18 QUALIFY row_number() OVER (PARTITION BY site ORDER BY people DESC, hour) = 1"


def noise_and_capacity(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    return o.select("o_custkey", F.round(rating.beyond_noise(F.col("v") - 2_000_000, F.lit(500_000.0)), 2).alias("effect"), rating.capacity_verdict(F.col("n") * 60.0, F.lit(2)).alias("verdict"))


NOISE_SQL = "SELECT o_custkey, round(CASE WHEN abs(sum(o_totalprice) - 2000000) > 500000 THEN sum(o_totalprice) - 2000000 END, 2) AS effect, CASE WHEN count(*) * 60 / 1400 < 0.6 THEN 'spare' WHEN count(*) * 60 / 1400 < 0.85 THEN 'busy' ELSE 'full' END AS verdict FROM orders GROUP BY 1"


def index_quantiles(spark: SparkSession, d: str) -> DataFrame:
    li, key = t.table(spark, d, "lineitem"), ["l_suppkey"]
    x = stats.placed(li, key, F.col("l_extendedprice")).groupBy(*key).agg(stats.index_quantile(0.9).alias("q90"), stats.upper_median().alias("upper_median"), stats.lower_quantile(0.25).alias("lower_q25"), F.round(stats.quantile(0.5), 6).alias("median"))
    q = stats.placed(li, key, F.col("l_quantity")).groupBy(*key).agg(F.round(stats.middle_mean(), 6).alias("middle_mean"))
    return x.join(q, key)


INDEX_SQL = """WITH s AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS x, list_sort(list(l_quantity)) AS q, count(*) AS n, median(l_extendedprice) AS m FROM lineitem GROUP BY 1)
SELECT l_suppkey, x[CAST(least(n - 1, floor(0.9::DOUBLE * n)) + 1 AS BIGINT)] AS q90, x[CAST(least(n - 1, floor(0.5::DOUBLE * n)) + 1 AS BIGINT)] AS upper_median, x[CAST(floor(0.25::DOUBLE * (n - 1)) + 1 AS BIGINT)] AS lower_q25, round(list_avg(CASE WHEN 3 * n // 4 > n // 4 THEN q[n // 4 + 1 : 3 * n // 4] ELSE q END), 6) AS middle_mean, round(m, 6) AS median FROM s"""

QUERIES = {
    "queue_fold": (queue_fold, FOLD_SQL),
    "compare_windows": (compare_windows, COMPARE_SQL),
    "plan_window_jaccard": (plan_window_jaccard, JACCARD_SQL),
    "severity_modes": (severity_modes, f"WITH {VALUES} SELECT request, mode, severity, metric FROM r"),
    "severity_rating": (severity_rating, OVERALL_SQL),
    "footpath_check": (footpath_check, FOOTPATH_SQL),
    "round_robin_top5": (round_robin_top5, ROBIN_SQL),
    "lanes_and_spread": (lanes_and_spread, LANES_SQL),
    "weekday_peak": (weekday_peak, PEAK_SQL),
    "noise_and_capacity": (noise_and_capacity, NOISE_SQL),
    "index_quantiles": (index_quantiles, INDEX_SQL),
}
