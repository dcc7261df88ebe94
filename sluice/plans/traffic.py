"""Volumes, calendars, exposure and the impact lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar, stats
from ..functions.recovery import cut
from ..operators import exposure, lookup
from . import tables as t


def baseline_change_quantiles(spark: SparkSession, d: str) -> DataFrame:
    changes = lookup.against_baseline(t.daily(spark, d), ["site_no"], "day", "volume")
    out = lookup.quantile_summary(changes, ["site_no"])
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("site_no", "n", r("p10"), r("p50"), r("p90"), r("mean_change"), r("share_over_15pct_drop"))


BASELINE = f"""WITH {t.DAILY}, prior AS (SELECT site_no, day + k AS day, volume FROM daily, (SELECT unnest([7,14,21,28,35,42]) AS k)),
b AS (SELECT o.site_no, o.day, o.volume, median(p.volume) AS base, count(*) AS n FROM daily o JOIN prior p ON o.site_no = p.site_no AND o.day = p.day GROUP BY ALL),
c AS (SELECT site_no, day, volume, volume / base - 1 AS change FROM b WHERE n >= 3 AND base > 0)"""
BASELINE_SQL = BASELINE + """
SELECT site_no, count(*) AS n, round(quantile_cont(change, 0.1), 6) AS p10, round(quantile_cont(change, 0.5), 6) AS p50, round(quantile_cont(change, 0.9), 6) AS p90, round(avg(change), 6) AS mean_change, round(avg(CASE WHEN change < -0.15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_over_15pct_drop FROM c GROUP BY 1 HAVING count(*) >= 20"""


def detector_slots(spark: SparkSession, d: str) -> DataFrame:
    """Users as detectors: an array of 96 quarter-hour counts a day (null where nothing was counted, negative where a count is odd)."""
    e = t.table(spark, d, "events").select("event_type", "user_id", F.to_date("ts").alias("day"), (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("int").alias("q"), F.floor("value").cast("long").alias("v"))
    e = e.groupBy("event_type", "user_id", "day", "q").agg(F.when(F.sum("v") % 7 == 0, -1).otherwise(F.sum("v")).alias("v"))
    m = e.groupBy("event_type", "user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("q", "v"))).alias("m"))
    return m.select(F.col("event_type").alias("site_no"), F.col("user_id").alias("detector"), F.col("day").alias("date_local"), F.lit("north").alias("region"), F.array(*[F.try_element_at("m", F.lit(q)) for q in range(96)]).alias("slots"))


def quarter_hours_to_site_hours(spark: SparkSession, d: str) -> DataFrame:
    return exposure.site_hours(exposure.hour_slots(detector_slots(spark, d)))


SLOTS_SQL = """WITH e AS (SELECT event_type, user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) * 4 + floor(minute(ts) / 15) AS INTEGER) AS q, CAST(floor(value) AS BIGINT) AS v FROM events),
s AS (SELECT event_type, user_id, day, q, CASE WHEN sum(v) % 7 = 0 THEN -1 ELSE sum(v) END AS v FROM e GROUP BY ALL),
dd AS (SELECT DISTINCT event_type, user_id, day FROM s), h AS (SELECT dd.*, hh.h FROM dd, (SELECT unnest(range(24)) AS h) hh),
x AS (SELECT h.event_type, h.user_id, h.day, h.h, sum(CASE WHEN s.v >= 0 THEN s.v END) AS volume, 4 - count(CASE WHEN s.v >= 0 THEN 1 END) AS n_missing FROM h LEFT JOIN s ON s.event_type = h.event_type AND s.user_id = h.user_id AND s.day = h.day AND s.q // 4 = h.h GROUP BY ALL)
SELECT event_type AS site_no, day AS date_local, CAST(h AS INTEGER) AS hour_local, CAST(sum(volume) AS BIGINT) AS volume, count(DISTINCT user_id) AS n_detectors, CAST(sum(n_missing) AS BIGINT) AS n_missing_slots, 'north' AS region FROM x GROUP BY 1, 2, 3"""


def site_hour_rollup(spark: SparkSession, d: str) -> DataFrame:
    return t.site_hours(spark, d).select("site", "day", "hour", F.round("volume", 4).alias("volume"), "n_detectors", "n_rows")


def site_day_completeness(spark: SparkSession, d: str) -> DataFrame:
    hours = t.site_hours(spark, d).select(F.col("site").alias("site_no"), F.col("day").alias("date_local"), "volume", F.lit(0).alias("n_missing_slots"))
    return exposure.site_days(hours).select("site_no", "date_local", "hours", F.round("daily_volume", 4).alias("daily_volume"), "site_day_complete")


def hourly_share_profile(spark: SparkSession, d: str) -> DataFrame:
    h = t.site_hours(spark, d).withColumn("day_type", calendar.day_type(F.col("day"), F.lit(None).cast("string")))
    p = h.groupBy("day_type", "hour").agg((F.sum("volume") / F.countDistinct("day")).alias("vehicles"), F.countDistinct("day").alias("n_days"), F.countDistinct("site").alias("n_sites"))
    share = F.col("vehicles") / F.sum("vehicles").over(Window.partitionBy("day_type"))
    return p.select("day_type", "hour", F.round("vehicles", 7).alias("vehicles"), "n_days", "n_sites", F.round(share, 6).alias("share_of_day"))


DAY_TYPE = "CASE isodow(day) WHEN 6 THEN 'Saturday' WHEN 7 THEN 'Sunday' ELSE 'Weekday' END"
PROFILE_SQL = f"""WITH {t.SITE_HOURS}, p AS (SELECT {DAY_TYPE} AS day_type, hour, sum(volume) / count(DISTINCT day) AS vehicles, count(DISTINCT day) AS n_days, count(DISTINCT site) AS n_sites FROM site_hours GROUP BY ALL)
SELECT day_type, hour, round(vehicles, 7) AS vehicles, n_days, n_sites, round(vehicles / sum(vehicles) OVER (PARTITION BY day_type), 6) AS share_of_day FROM p"""


def site_daily_by_day_type(spark: SparkSession, d: str) -> DataFrame:
    days = t.daily(spark, d).withColumn("day_type", calendar.day_type(F.col("day"), F.lit(None).cast("string")))
    return days.groupBy("site_no", "day_type").agg(F.countDistinct("day").alias("n_days"), F.round(F.avg("volume"), 6).alias("avg_daily"), F.round(F.median("volume"), 6).alias("median_daily")).orderBy("day_type", F.desc("avg_daily"), "site_no")


SITE_DAILY_SQL = f"WITH {t.DAILY} SELECT site_no, {DAY_TYPE} AS day_type, count(DISTINCT day) AS n_days, round(avg(volume), 6) AS avg_daily, round(median(volume), 6) AS median_daily FROM daily GROUP BY 1, 2"


def holiday_calendar(spark: SparkSession, d: str) -> DataFrame:
    return calendar.public_holidays(spark, 2015, 2030)


def _nth(month: int, dow: int, n: int) -> str:
    first = f"make_date(y, {month}, 1)"
    return f"{first} + CAST(({dow} - isodow({first}) + 7) % 7 + {7 * (n - 1)} AS INTEGER)"


FRIDAYS = ", ".join(f"({y}, DATE '{v}')" for y, v in calendar.GRAND_FINAL_FRIDAY.items())
# Easter Sundays from 1995 to 2030, against which the engine's rule is held.
EASTER = "1995-04-16 1996-04-07 1997-03-30 1998-04-12 1999-04-04 2000-04-23 2001-04-15 2002-03-31 2003-04-20 2004-04-11 2005-03-27 2006-04-16 2007-04-08 2008-03-23 2009-04-12 2010-04-04 2011-04-24 2012-04-08 2013-03-31 2014-04-20 2015-04-05 2016-03-27 2017-04-16 2018-04-01 2019-04-21 2020-04-12 2021-04-04 2022-04-17 2023-04-09 2024-03-31 2025-04-20 2026-04-05 2027-03-28 2028-04-16 2029-04-01 2030-04-21".split()
HOLIDAY_SQL = f"""WITH y AS (SELECT CAST(unnest(range(2015, 2031)) AS BIGINT) AS y),
e AS (SELECT s FROM (VALUES {", ".join(f"(DATE '{x}')" for x in EASTER)}) v(s) JOIN y ON y = year(s)),
f(y, fri) AS (VALUES {FRIDAYS}),
d AS (SELECT 0 AS seq, make_date(y, 1, 1) AS day, 'New Year''s Day' AS name FROM y
UNION ALL SELECT 1, make_date(y, 1, 1) + CAST(8 - isodow(make_date(y, 1, 1)) AS INTEGER), 'New Year''s Day (observed)' FROM y WHERE isodow(make_date(y, 1, 1)) >= 6
UNION ALL SELECT 2, make_date(y, 1, 26), 'Australia Day' FROM y
UNION ALL SELECT 3, make_date(y, 1, 26) + CAST(8 - isodow(make_date(y, 1, 26)) AS INTEGER), 'Australia Day (observed)' FROM y WHERE isodow(make_date(y, 1, 26)) >= 6
UNION ALL SELECT 4, {_nth(3, 1, 2)}, 'Labour Day' FROM y
UNION ALL SELECT 5, s - 2, 'Good Friday' FROM e UNION ALL SELECT 6, s - 1, 'Easter Saturday' FROM e
UNION ALL SELECT 7, s, 'Easter Sunday' FROM e UNION ALL SELECT 8, s + 1, 'Easter Monday' FROM e
UNION ALL SELECT 9, make_date(y, 4, 25), 'ANZAC Day' FROM y
UNION ALL SELECT 10, {_nth(6, 1, 2)}, 'King''s/Queen''s Birthday' FROM y
UNION ALL SELECT 11, {_nth(11, 2, 1)}, 'Melbourne Cup' FROM y
UNION ALL SELECT 12, fri, 'Friday before AFL Grand Final' FROM f
UNION ALL SELECT 13, make_date(y, 12, 25), 'Christmas Day' FROM y UNION ALL SELECT 14, make_date(y, 12, 26), 'Boxing Day' FROM y
UNION ALL SELECT 15, make_date(y, 12, 27), 'Christmas Day (observed)' FROM y WHERE isodow(make_date(y, 12, 25)) IN (6, 7)
UNION ALL SELECT 16, make_date(y, 12, 28), 'Boxing Day (observed)' FROM y WHERE isodow(make_date(y, 12, 25)) IN (5, 6))
SELECT day, string_agg(name, ' / ' ORDER BY seq) AS holiday FROM d GROUP BY day"""


def day_type_calendar(spark: SparkSession, d: str) -> DataFrame:
    days = t.closures(spark, d).select(F.col("d_from").alias("day")).distinct()
    hol = calendar.public_holidays(spark, 1995, 2030)
    return days.join(F.broadcast(hol), "day", "left").select("day", calendar.day_type(F.col("day"), F.col("holiday")).alias("day_type"), calendar.weekday(F.col("day")).cast("int").alias("dow"), calendar.is_weekend(F.col("day")).alias("is_weekend"), calendar.month_label(F.col("day")).alias("month_label"))


DAY_TYPE_SQL = HOLIDAY_SQL.replace("range(2015, 2031)", "range(1995, 2031)").replace("SELECT day, string_agg(name, ' / ' ORDER BY seq) AS holiday FROM d GROUP BY day", f""", x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, CASE WHEN day IN (SELECT day FROM d) THEN 'Public holiday' ELSE {DAY_TYPE} END AS day_type, CAST(isodow(day) AS INTEGER) AS dow, isodow(day) >= 6 AS is_weekend, lower(strftime(day, '%B_%Y')) AS month_label FROM x""")


def time_band_volumes(spark: SparkSession, d: str) -> DataFrame:
    h = t.site_hours(spark, d)
    days = exposure.site_days(h.select(F.col("site").alias("site_no"), F.col("day").alias("date_local"), "volume", F.lit(0).alias("n_missing_slots"))).where("site_day_complete")
    bands = h.join(days, (h["site"] == days["site_no"]) & (h["day"] == days["date_local"])).groupBy("site", "day", calendar.time_band(F.col("hour")).alias("time_band"))
    return bands.agg(F.round(F.sum("volume"), 4).alias("volume"), F.round(F.first("daily_volume"), 4).alias("daily_volume"))


BAND = "CASE WHEN hour BETWEEN 7 AND 8 THEN 'AM peak' WHEN hour BETWEEN 9 AND 15 THEN 'Inter-peak' WHEN hour BETWEEN 16 AND 18 THEN 'PM peak' ELSE 'Night' END"
BANDS_SQL = f"WITH {t.SITE_HOURS}, x AS (SELECT site, day, sum(volume) AS daily FROM site_hours GROUP BY 1, 2 HAVING count(*) = 24 AND sum(volume) > 0) SELECT s.site, s.day, {BAND} AS time_band, round(sum(s.volume), 4) AS volume, round(any_value(x.daily), 4) AS daily_volume FROM site_hours s JOIN x ON x.site = s.site AND x.day = s.day GROUP BY 1, 2, 3"


def closure_spine(spark: SparkSession, d: str) -> DataFrame:
    """Summed over the whole spine: a row per closure type, day offset and band. Equal days are counted before they get their hours."""
    keys = ["closure_type", "day_offset", "is_closure_day", "is_baseline_week", "is_weekend", "dow"]
    days = exposure.flagged_days(t.closures(spark, d).select("d_from", "d_to", "closure_type")).groupBy(*keys).agg(F.count("*").alias("days"))
    sums = lambda name, e: F.sum(F.col("days") * e).alias(name)
    flag = lambda c: F.col(c).cast("long")
    return exposure.hourly(days).groupBy("closure_type", "day_offset", "time_band").agg(F.sum("days").alias("n"), sums("n_closure", flag("is_closure_day")), sums("n_baseline", flag("is_baseline_week")), sums("n_weekend", flag("is_weekend")), sums("dow_sum", F.col("dow")))


SPINE_SQL = f"""WITH {t.CLOSURES}, s AS (SELECT closure_type, d_from, CAST(unnest(generate_series(d_from - 42, d_to, INTERVAL 1 DAY)) AS DATE) AS day FROM closures),
h AS (SELECT s.*, hh.hour, CAST(day - d_from AS INTEGER) AS day_offset FROM s, (SELECT unnest(range(24)) AS hour) hh)
SELECT closure_type, day_offset, {BAND} AS time_band, count(*) AS n, CAST(sum(CAST(day_offset >= 0 AS BIGINT)) AS BIGINT) AS n_closure, CAST(sum(CAST(day_offset IN (-42, -35, -28, -21, -14, -7) AS BIGINT)) AS BIGINT) AS n_baseline, CAST(sum(CAST(isodow(day) >= 6 AS BIGINT)) AS BIGINT) AS n_weekend, CAST(sum(isodow(day)) AS BIGINT) AS dow_sum FROM h GROUP BY 1, 2, 3"""


def duration_filter_stats(spark: SparkSession, d: str) -> DataFrame:
    c = exposure.short_closures(t.closures(spark, d), period=("1996-01-01", "2000-06-30")).withColumn("days", F.datediff("d_to", "d_from"))
    return c.groupBy("closure_type").agg(F.count("*").alias("n"), F.median("days").alias("median_days"), F.round(stats.share(F.col("days") == 1), 6).alias("share_1"), F.round(stats.share(F.col("days") <= 3), 6).alias("share_3"), F.round(stats.share(F.col("days") <= 7), 6).alias("share_7"), F.countDistinct("cust").alias("n_streets"), F.countDistinct(F.year("d_from")).alias("n_years"))


DURATION_SQL = f"WITH {t.CLOSURES}, c AS (SELECT *, d_to - d_from AS days FROM closures WHERE d_to >= DATE '1996-01-01' AND d_from <= DATE '2000-06-30' AND d_to - d_from BETWEEN 0 AND 7) SELECT closure_type, count(*) AS n, CAST(median(days) AS DOUBLE) AS median_days, round(avg(CAST(days = 1 AS DOUBLE)), 6) AS share_1, round(avg(CAST(days <= 3 AS DOUBLE)), 6) AS share_3, round(avg(CAST(days <= 7 AS DOUBLE)), 6) AS share_7, count(DISTINCT cust) AS n_streets, count(DISTINCT year(d_from)) AS n_years FROM c GROUP BY 1"


def busy_day_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Site-days with and without a closure of the type that closes the road (here the urgent ones)."""
    c = t.closures(spark, d).where("closure_type = '1-URGENT'")
    days = t.daily(spark, d).withColumnRenamed("day", "date_local")
    marked = exposure.flag_busy(days, exposure.busy_days(c))
    return marked.groupBy("site_no").agg(F.count("*").alias("n_days"), F.sum(F.col("site_has_closure_that_day").cast("long")).alias("n_busy"), F.round(F.sum(F.when(~F.col("site_has_closure_that_day"), F.col("volume"))), 4).alias("free_volume"))


BUSY_SQL = f"WITH {t.CLOSURES}, {t.DAILY}, b AS (SELECT DISTINCT site_no, CAST(unnest(generate_series(d_from, d_to, INTERVAL 1 DAY)) AS DATE) AS day FROM closures WHERE closure_type = '1-URGENT'), free AS (SELECT * FROM daily d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.site_no = d.site_no AND b.day = d.day)) SELECT d.site_no, count(*) AS n_days, count(*) - count(f.day) AS n_busy, round(sum(f.volume), 4) AS free_volume FROM daily d LEFT JOIN free f ON f.site_no = d.site_no AND f.day = d.day GROUP BY 1"


def free_days(spark: SparkSession, d: str) -> DataFrame:
    """The anti-join form: site-days without a closure that closes the road (here the urgent ones)."""
    c = t.closures(spark, d).where("closure_type = '1-URGENT'")
    return t.daily(spark, d).withColumnRenamed("day", "date_local").join(exposure.busy_days(c), ["site_no", "date_local"], "left_anti").select("site_no", "date_local", F.round("volume", 4).alias("volume"))


FREE_SQL = f"WITH {t.CLOSURES}, {t.DAILY}, b AS (SELECT DISTINCT site_no, CAST(unnest(generate_series(d_from, d_to, INTERVAL 1 DAY)) AS DATE) AS day FROM closures WHERE closure_type = '1-URGENT') SELECT site_no, day AS date_local, round(volume, 4) AS volume FROM daily d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.site_no = d.site_no AND b.day = d.day)"


def wide_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Daily volumes of closure days with six left joins, summed by region and type."""
    c = t.closures(spark, d)
    days = exposure.days_of(c.select("radar_id", "site_no", "cust", "d_from", "d_to"), 0).drop("d_from", "d_to")
    cust = t.table(spark, d, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nk"), "c_mktsegment")
    nation = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"))
    region = t.table(spark, d, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region"))
    hol = calendar.public_holidays(spark, 1995, 2002).select(F.col("day").alias("date_local"), "holiday")
    vol = t.daily(spark, d).withColumnRenamed("day", "date_local")
    wide = days.join(vol, ["site_no", "date_local"], "left").join(cust, "cust", "left").join(nation, "nk", "left").join(region, "rk", "left").join(hol, "date_local", "left").join(c.select("radar_id", "closure_type"), "radar_id", "left")
    return wide.groupBy("region", "closure_type", "c_mktsegment").agg(F.count("*").alias("n"), F.count("volume").alias("n_volume"), F.round(F.sum("volume"), 2).alias("volume"), F.count("holiday").alias("n_holiday"))


WIDE_SQL = HOLIDAY_SQL.replace("range(2015, 2031)", "range(1995, 2003)").replace("SELECT day, string_agg(name, ' / ' ORDER BY seq) AS holiday FROM d GROUP BY day", f""", hol AS (SELECT DISTINCT day FROM d WHERE year(day) < 2003), {t.CLOSURES}, {t.DAILY},
cd AS (SELECT radar_id, site_no, cust, closure_type, CAST(unnest(generate_series(d_from, d_to, INTERVAL 1 DAY)) AS DATE) AS day FROM closures)
SELECT r_name AS region, closure_type, c_mktsegment, count(*) AS n, count(v.volume) AS n_volume, round(sum(v.volume), 2) AS volume, count(hol.day) AS n_holiday FROM cd LEFT JOIN daily v ON v.site_no = cd.site_no AND v.day = cd.day LEFT JOIN customer ON c_custkey = cust LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN hol ON hol.day = cd.day GROUP BY 1, 2, 3""")


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Closures' site-day changes with the lookup's five keys."""
    c = t.closures(spark, d).select("radar_id", "site_no", "d_from", "d_to", "closure_type", "work_window")
    days = exposure.days_of(c, 0)
    moved = lookup.against_baseline(t.daily(spark, d), ["site_no"], "day", "volume").select("site_no", F.col("day").alias("date_local"), F.col("volume").alias("daily_volume"), "change")
    rel = F.when(F.pmod("radar_id", F.lit(2)) == 0, "same street").otherwise("cross street")
    band = F.element_at(F.array(*[F.lit(b) for b in ("AM peak", "Inter-peak", "PM peak", "Night")]), (F.pmod(F.weekday("date_local"), F.lit(4)) + 1).cast("int"))
    return days.join(moved, ["site_no", "date_local"]).select("radar_id", "site_no", "date_local", "d_from", "closure_type", "work_window", rel.alias("site_relation"), band.alias("time_band"), "change", "daily_volume")


KEYS = ["radar_id", "closure_type", "work_window", "time_band", "site_relation", "d_from"]
BANDS_LIST = "['AM peak', 'Inter-peak', 'PM peak', 'Night']"
CHANGES = BASELINE + f""", {t.CLOSURES}, cd AS (SELECT radar_id, site_no, d_from, closure_type, work_window, CAST(unnest(generate_series(d_from, d_to, INTERVAL 1 DAY)) AS DATE) AS date_local FROM closures),
ch AS (SELECT radar_id, cd.site_no, date_local, d_from, closure_type, work_window, CASE WHEN radar_id % 2 = 0 THEN 'same street' ELSE 'cross street' END AS site_relation, {BANDS_LIST}[CAST((isodow(date_local) - 1) % 4 + 1 AS INTEGER)] AS time_band, change, volume AS daily_volume FROM cd JOIN c ON c.site_no = cd.site_no AND c.day = cd.date_local),
pc AS (SELECT radar_id, closure_type, work_window, time_band, site_relation, d_from, median(change) AS change, median(daily_volume) AS site_daily_volume, count(DISTINCT date_local) AS n_days, count(DISTINCT site_no) AS n_sites FROM ch GROUP BY ALL),
k AS (SELECT *, CASE WHEN site_daily_volume * 400 < 20000 THEN 'low (<20k/day)' WHEN site_daily_volume * 400 < 40000 THEN 'medium (20-40k/day)' ELSE 'high (>40k/day)' END AS road_class FROM pc)"""
STATS = "count(*) AS n_closures, quantile_cont(change, 0.1) AS p10, quantile_cont(change, 0.5) AS p50, quantile_cont(change, 0.9) AS p90, avg(change) AS mean_change, avg(CASE WHEN change < -0.15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_over_15pct_drop"


def _lookup_cte(source: str) -> str:
    return f"""lk AS (SELECT 1 AS level, site_relation, closure_type, work_window, time_band, road_class, {STATS} FROM {source} GROUP BY 2, 3, 4, 5, 6 HAVING count(*) >= 20
UNION ALL SELECT 2, site_relation, closure_type, work_window, time_band, 'any', {STATS} FROM {source} GROUP BY 2, 3, 4, 5 HAVING count(*) >= 20
UNION ALL SELECT 3, site_relation, 'any', 'any', time_band, 'any', {STATS} FROM {source} GROUP BY 2, 5 HAVING count(*) >= 20)"""


ROUNDED = "round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, round(mean_change, 6) AS mean_change, round(share_over_15pct_drop, 6) AS share_over_15pct_drop"


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    pc = lookup.per_closure(changes(spark, d), KEYS)
    return pc.withColumn("road_class", lookup.road_class(F.col("site_daily_volume") * 400))


def per_closure_change(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(spark, d).select(*KEYS, F.round("change", 6).alias("change"), F.round("site_daily_volume", 4).alias("site_daily_volume"), "n_days", "n_sites", "road_class")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("p10", "p50", "p90", "mean_change", "share_over_15pct_drop")})


def lookup_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(lookup.build(collapsed(spark, d)))


def _tested(spark: SparkSession, d: str, ranked: bool = False) -> DataFrame:
    train, test = lookup.split(cut(collapsed(spark, d)), "2000-01-01")
    table = cut(lookup.build(train))  # joined once for each level
    if ranked:
        rows = test.withColumn("rid", F.concat_ws("|", "radar_id", "time_band"))
        return lookup.find_ranked(rows, table, "rid").drop("rid")
    return lookup.find(test, table)


def lookup_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    return _tested(spark, d).select("radar_id", "time_band", "site_relation", "level", "n_closures", F.round("p50", 6).alias("p50"))


def lookup_fallback_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _tested(spark, d, ranked=True).select("radar_id", "time_band", "site_relation", "level", "n_closures", F.round("p50", 6).alias("p50"))


TESTED = CHANGES + ", tr AS (SELECT * FROM k WHERE d_from < DATE '2000-01-01'), te AS (SELECT * FROM k WHERE d_from >= DATE '2000-01-01'), " + _lookup_cte("tr") + """,
hit AS (SELECT te.*, lk.level, lk.n_closures, lk.p10, lk.p50, lk.p90, lk.share_over_15pct_drop FROM te JOIN lk ON te.site_relation = lk.site_relation AND te.time_band = lk.time_band AND (lk.level = 3 OR (te.closure_type = lk.closure_type AND te.work_window = lk.work_window AND (lk.level = 2 OR te.road_class = lk.road_class)))
QUALIFY row_number() OVER (PARTITION BY te.radar_id, te.time_band ORDER BY lk.level) = 1)"""
FALLBACK_SQL = TESTED + " SELECT radar_id, time_band, site_relation, level, n_closures, round(p50, 6) AS p50 FROM hit"


def holdout_validation(spark: SparkSession, d: str) -> DataFrame:
    out = lookup.validation(_tested(spark, d))
    return out.select("site_relation", "n_test", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


VALID_SQL = TESTED + " SELECT site_relation, count(*) AS n_test, round(median(abs(change - p50)), 6) AS mae_model, round(median(abs(change)), 6) AS mae_no_change, round(avg(abs(change - p50)), 6) AS mean_abs_err_model, round(avg(abs(change)), 6) AS mean_abs_err_no_change, round(avg(CAST(change BETWEEN p10 AND p90 AS DOUBLE)), 6) AS p10_p90_coverage, round(avg(CAST(level = 1 AS DOUBLE)), 6) AS share_level1 FROM hit GROUP BY 1"


def risk_band_calibration(spark: SparkSession, d: str) -> DataFrame:
    out = lookup.calibration(_tested(spark, d))
    return out.select("site_relation", "predicted_risk_band", "n_test", F.round("predicted_share_over_15pct_drop", 6).alias("predicted"), F.round("actual_share_over_15pct_drop", 6).alias("actual"))


CALIB_SQL = TESTED + " SELECT site_relation, CASE WHEN share_over_15pct_drop < 0.1 THEN '<10%' WHEN share_over_15pct_drop < 0.2 THEN '10-20%' WHEN share_over_15pct_drop < 0.3 THEN '20-30%' ELSE '>30%' END AS predicted_risk_band, count(*) AS n_test, round(avg(share_over_15pct_drop), 6) AS predicted, round(avg(CAST(change < -0.15 AS DOUBLE)), 6) AS actual FROM hit GROUP BY 1, 2"


def newest_row(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer the newest order; the larger key among equals."""
    o = t.table(spark, d, "orders").withColumn("o", F.struct("o_orderdate", "o_orderkey"))
    return exposure.newest(o, ["o_custkey"], "o").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))


NEWEST_SQL = "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def first_known_site(spark: SparkSession, d: str) -> DataFrame:
    """One row per nation of its suppliers: the first name that is not null, mean balance."""
    s = t.table(spark, d, "supplier").withColumn("name", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")))
    return exposure.first_known(s, ["s_nationkey"], "s_suppkey", ["name"], ["s_acctbal"]).select("s_nationkey", "name", F.round("s_acctbal", 7).alias("mean_bal"))


FIRST_SQL = "SELECT s_nationkey, arg_min(s_name, s_suppkey) FILTER (s_suppkey % 3 <> 0) AS name, round(avg(s_acctbal), 7) AS mean_bal FROM supplier GROUP BY 1"


def directions_summed(spark: SparkSession, d: str) -> DataFrame:
    li = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("segment_id"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("aadt"), F.col("l_tax").alias("aadt_heavy"), F.col("l_returnflag").alias("direction"))
    return exposure.directions_summed(li).select("segment_id", "year", F.round("aadt", 4).alias("aadt"), F.round("aadt_heavy", 4).alias("aadt_heavy"), "aadt_directions")


DIRECTIONS_SQL = "SELECT l_suppkey AS segment_id, CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_quantity), 4) AS aadt, round(sum(l_tax), 4) AS aadt_heavy, string_agg(DISTINCT l_returnflag, ' + ' ORDER BY l_returnflag) AS aadt_directions FROM lineitem GROUP BY 1, 2"


def epoch_local_dates(spark: SparkSession, d: str) -> DataFrame:
    """Local dates of instants, by zone with daylight saving."""
    e = t.table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return e.select("event_id", calendar.local_date(F.col("ms")).alias("local_day"))


QUERIES = {
    "baseline_change_quantiles": (baseline_change_quantiles, BASELINE_SQL),
    "quarter_hours_to_site_hours": (quarter_hours_to_site_hours, SLOTS_SQL),
    "site_hour_rollup": (site_hour_rollup, f"WITH {t.SITE_HOURS} SELECT site, day, hour, round(volume, 4) AS volume, n_detectors, n_rows FROM site_hours"),
    "site_day_completeness": (site_day_completeness, f"WITH {t.SITE_HOURS} SELECT site AS site_no, day AS date_local, count(*) AS hours, round(sum(volume), 4) AS daily_volume, count(*) = 24 AND sum(volume) > 0 AS site_day_complete FROM site_hours GROUP BY 1, 2"),
    "hourly_share_profile": (hourly_share_profile, PROFILE_SQL),
    "site_daily_by_day_type": (site_daily_by_day_type, SITE_DAILY_SQL),
    "holiday_calendar": (holiday_calendar, HOLIDAY_SQL),
    "day_type_calendar": (day_type_calendar, DAY_TYPE_SQL),
    "time_band_volumes": (time_band_volumes, BANDS_SQL),
    "closure_spine": (closure_spine, SPINE_SQL),
    "duration_filter_stats": (duration_filter_stats, DURATION_SQL),
    "busy_day_flags": (busy_day_anti_join, BUSY_SQL),
    "busy_day_anti_join": (free_days, FREE_SQL),
    "wide_enrichment": (wide_enrichment, WIDE_SQL),
    "per_closure_change": (per_closure_change, CHANGES + " SELECT radar_id, closure_type, work_window, time_band, site_relation, d_from, round(change, 6) AS change, round(site_daily_volume, 4) AS site_daily_volume, n_days, n_sites, road_class FROM k"),
    "lookup_grouping_sets": (lookup_grouping_sets, CHANGES + ", " + _lookup_cte("k") + f" SELECT level, site_relation, closure_type, work_window, time_band, road_class, n_closures, {ROUNDED} FROM lk"),
    "lookup_fallback_join": (lookup_fallback_join, FALLBACK_SQL),
    "lookup_fallback_ranked": (lookup_fallback_ranked, FALLBACK_SQL),
    "holdout_validation": (holdout_validation, VALID_SQL),
    "risk_band_calibration": (risk_band_calibration, CALIB_SQL),
    "newest_row_wins": (newest_row, NEWEST_SQL),
    "first_known_site": (first_known_site, FIRST_SQL),
    "directions_summed": (directions_summed, DIRECTIONS_SQL),
    "epoch_local_dates": (epoch_local_dates, "SELECT event_id, CAST(timezone('Australia/Melbourne', timezone('UTC', ts)) AS DATE) AS local_day FROM events"),
}
