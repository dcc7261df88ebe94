"""Paired runs, sequences over ordered bins, and street graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, runs
from . import tables as t


def _trips(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems as trips: the return flag tells the case, the line number the seed."""
    li = t.table(spark, d, "lineitem").where("l_returnflag in ('A', 'N')").groupBy("l_partkey", "l_linenumber", "l_returnflag").agg(F.sum("l_quantity").alias("duration"))
    return li.select(F.when(F.col("l_returnflag") == "A", "base").otherwise("closure").alias("case"), F.col("l_linenumber").cast("int").alias("seed"), F.col("l_partkey").alias("trip"), "duration")


TRIPS = "trips AS (SELECT CASE l_returnflag WHEN 'A' THEN 'base' ELSE 'closure' END AS \"case\", CAST(l_linenumber AS INTEGER) AS seed, l_partkey AS trip, sum(l_quantity) AS duration FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL)"


def paired_run_delay(spark: SparkSession, d: str) -> DataFrame:
    x = _trips(spark, d)
    pairs = runs.paired(x.where("case = 'base'"), x.where("case = 'closure'"), ["seed", "trip"], "duration")
    return runs.delay_hours(pairs, ["seed"]).select("seed", F.round("delay_veh_h", 6).alias("delay_veh_h"), "n_trips")


PAIRED = f"WITH {TRIPS}, p AS (SELECT b.seed, b.trip, c.duration - b.duration AS diff FROM trips b JOIN trips c ON b.seed = c.seed AND b.trip = c.trip WHERE b.\"case\" = 'base' AND c.\"case\" = 'closure')"


def seed_spread(spark: SparkSession, d: str) -> DataFrame:
    totals = _trips(spark, d).groupBy("case", "seed").agg(F.sum("duration").alias("total"))
    return runs.seed_spread(totals, ["case"], "total")


def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    out = runs.seed_noise(_trips(spark, d).where("case = 'base'"), "seed", ["trip"], "duration")
    return out.select("seed", "next_seed", F.round("noise", 4).alias("noise"), "n")


NOISE_SQL = f"WITH {TRIPS} SELECT a.seed, b.seed AS next_seed, round(sum(b.duration - a.duration), 4) AS noise, count(*) AS n FROM trips a JOIN trips b ON a.trip = b.trip AND b.seed = (SELECT min(seed) FROM trips x WHERE x.seed > a.seed AND x.\"case\" = 'base') WHERE a.\"case\" = 'base' AND b.\"case\" = 'base' GROUP BY 1, 2"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    li = t.table(spark, d, "lineitem")
    by = [F.col("l_suppkey").alias("edge"), F.month("l_shipdate").alias("hour")]
    counted = li.groupBy(*by).agg(F.sum("l_quantity").alias("counted"))
    simulated = li.where("l_returnflag <> 'R'").groupBy(*by).agg(F.sum(F.col("l_quantity") * (1 - F.col("l_discount")) * 1.6).alias("simulated"))
    return runs.against_counts(simulated, counted, ["edge", "hour"])


COUNTS = "c AS (SELECT l_suppkey AS edge, CAST(month(l_shipdate) AS INTEGER) AS hour, sum(l_quantity) AS counted, coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity * (1 - l_discount) * 1.6::DOUBLE END), 0) AS simulated FROM lineitem GROUP BY 1, 2), g AS (SELECT *, CASE WHEN simulated + counted = 0 THEN 0 ELSE sqrt(2 * pow(simulated - counted, 2) / (simulated + counted)) END AS geh FROM c)"


def geh_calibration(spark: SparkSession, d: str) -> DataFrame:
    out = runs.geh_report(_counts(spark, d), ["hour"])
    return out.select("hour", "n", *[F.round(c, 6).alias(c) for c in ("share_under_5", "share_under_10", "mean_geh")], F.round("counted", 2).alias("counted"), F.round("simulated", 2).alias("simulated"))


def worst_edges(spark: SparkSession, d: str) -> DataFrame:
    return runs.worst(_counts(spark, d), "edge").select("edge", F.round("abs_error", 3).alias("abs_error"))


def proportional_allocation(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders").join(t.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", F.lit(1000.0).alias("total"), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("double").alias("lanes"))
    return runs.allocated(o, ["c_nationkey"], "total", "lanes").select("o_orderkey", F.round("allocated", 6).alias("allocated"))


def street_changes(spark: SparkSession, d: str) -> DataFrame:
    n = _trips(spark, d).select("case", F.pmod("trip", F.lit(40)).alias("street"), "seed").groupBy("case", "street").agg(F.count("*").alias("n")).withColumn("n_seeds", F.lit(7))
    out = runs.street_changes(n)
    return out.select("street", *[F.round(c, 6).alias(c) for c in ("base", "closure", "change")], "verdict")


STREETS_SQL = f"WITH {TRIPS}, s AS (SELECT trip % 40 AS street, count(CASE WHEN \"case\" = 'base' THEN 1 END) / 7.0::DOUBLE AS base, count(CASE WHEN \"case\" = 'closure' THEN 1 END) / 7.0::DOUBLE AS closure FROM trips GROUP BY 1) SELECT street, round(base, 6) AS base, round(closure, 6) AS closure, round(closure - base, 6) AS change, CASE WHEN closure - base > 0.05::DOUBLE * base THEN 'gained' WHEN closure - base < -0.05::DOUBLE * base THEN 'relieved' ELSE 'same' END AS verdict FROM s"


def closed_edge_users(spark: SparkSession, d: str) -> DataFrame:
    """Orders as routes over their parts; those that touch parts 1, 7 or 20 use the closed block."""
    r = t.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: (s["l_partkey"] % 50).cast("string")).alias("edges"))
    used = runs.users_of(graph.prune_routes(r, ["1", "7", "20"]).drop("passes"), ["1", "7", "20"])
    return used.groupBy("uses_closed").agg(F.count("*").alias("n"), F.sum(F.size("edges").cast("long")).alias("n_edges"))


USERS_SQL = "WITH r AS (SELECT l_orderkey, list(CAST(l_partkey % 50 AS VARCHAR) ORDER BY l_linenumber, l_partkey) AS edges FROM lineitem GROUP BY 1) SELECT list_has_any(edges, ['1', '7', '20']) AS uses_closed, count(*) AS n, CAST(sum(len(edges)) AS BIGINT) AS n_edges FROM r WHERE NOT list_contains(['1', '7', '20'], edges[1]) AND NOT list_contains(['1', '7', '20'], edges[-1]) GROUP BY 1"


def route_density(spark: SparkSession, d: str) -> DataFrame:
    li = t.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("edge"), "l_linenumber").distinct()
    return li.groupBy("edge").agg((F.count("*") / 5.0).alias("users_per_seed"))


def _user_hours(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "events").select("user_id", (F.dayofyear("ts") * 24 + F.hour("ts")).cast("long").alias("bin"), "value")


USER_HOURS = "u AS (SELECT user_id, CAST(dayofyear(ts) * 24 + hour(ts) AS BIGINT) AS bin, value FROM events)"


def gap_tolerant_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.longest_run(_user_hours(spark, d).select("user_id", "bin").distinct(), ["user_id"], "bin", 8)


RUNS_SQL = f"WITH {USER_HOURS}, x AS (SELECT DISTINCT user_id, bin FROM u), y AS (SELECT *, CASE WHEN bin - lag(bin) OVER w > 9 THEN 1 ELSE 0 END AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY bin)), z AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY bin) AS r FROM y), g AS (SELECT user_id, min(bin) AS first, max(bin) AS last, max(bin) - min(bin) + 1 AS length FROM z GROUP BY user_id, r) SELECT user_id, first, last, length FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first) = 1"


def pinch_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = _user_hours(spark, d).groupBy("user_id", "bin").agg(F.round(F.max("value"), 4).alias("width"))
    return runs.pinch(s, ["user_id"], "bin", "width")


PINCH_SQL = f"WITH {USER_HOURS}, s AS (SELECT user_id, bin, round(max(value), 4) AS width FROM u GROUP BY 1, 2), p AS (SELECT user_id, bin, CASE WHEN lead(bin) OVER w = bin + 1 THEN greatest(width, lead(width) OVER w) END AS pw FROM s WINDOW w AS (PARTITION BY user_id ORDER BY bin)) SELECT user_id, pw AS pinch, bin AS \"at\" FROM p WHERE pw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pw, bin) = 1"


def until_first_bad(spark: SparkSession, d: str) -> DataFrame:
    return runs.until_first_bad(_user_hours(spark, d), ["user_id"], "bin", F.col("value") > 95)


def half_hour_interpolation(spark: SparkSession, d: str) -> DataFrame:
    h = t.site_hours(spark, d)
    return runs.half_hours(h, ["site", "day"], "hour", "volume").select("site", "day", "hour", F.round("half_hour_value", 4).alias("half_hour_value"))


HALF_SQL = f"WITH {t.SITE_HOURS} SELECT site, day, hour, round(0.5::DOUBLE * volume + 0.5::DOUBLE * coalesce(lead(volume) OVER (PARTITION BY site, day ORDER BY hour), volume), 4) AS half_hour_value FROM site_hours"


def trailing_mean(spark: SparkSession, d: str) -> DataFrame:
    s = _user_hours(spark, d).groupBy("user_id", "bin").agg(F.sum("value").alias("value"))
    dense = runs.dense_seconds(s, ["user_id"], "bin", "value")
    return runs.trailing_mean(dense, ["user_id"], "bin", "value", 24).select("user_id", "bin", F.round("trailing_mean", 6).alias("trailing_mean"), runs.level_bands(F.col("value") / 50, F.col("trailing_mean")).alias("level"))


TRAILING_SQL = f"WITH {USER_HOURS}, s AS (SELECT user_id, bin, sum(value) AS value FROM u GROUP BY 1, 2), g AS (SELECT user_id, CAST(unnest(range(min(bin), max(bin) + 1)) AS BIGINT) AS bin FROM s GROUP BY 1), x AS (SELECT g.user_id, g.bin, coalesce(s.value, 0) AS value FROM g LEFT JOIN s ON s.user_id = g.user_id AND s.bin = g.bin), y AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY bin RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS m FROM x) SELECT user_id, bin, round(m, 6) AS trailing_mean, CASE WHEN value / 50 < 2 THEN 0 WHEN value / 50 / greatest(m, 1) < 0.2 THEN 0 WHEN value / 50 / greatest(m, 1) < 0.5 THEN 1 WHEN value / 50 / greatest(m, 1) < 1 THEN 2 ELSE 3 END AS level FROM y"


def running_distinct(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    return runs.running_distinct(e, ["event_type"], "day", "user_id")


RUNNING_SQL = "WITH f AS (SELECT event_type, user_id, min(CAST(ts AS DATE)) AS day FROM events GROUP BY 1, 2), n AS (SELECT event_type, day, count(*) AS new FROM f GROUP BY 1, 2) SELECT event_type, day, new, CAST(sum(new) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS seen FROM n"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """A sparse graph of suppliers' keys; edges of one remainder stand for those that cars may not use."""
    s = F.col("s_suppkey")
    e = t.table(spark, d, "supplier").select(F.explode(F.array(F.struct(s.alias("src"), (s * 2).alias("dst")), F.struct((s * 3).alias("src"), s.alias("dst")), F.struct(s.alias("src"), (s + 17).alias("dst")))).alias("e")).select("e.*")
    return e.where("src % 7 <> 3").withColumn("length", (F.pmod(F.col("src") * 31 + F.col("dst") * 17, F.lit(90)) + 10).cast("double"))


EDGES = "ed AS (SELECT src, dst, CAST((src * 31 + dst * 17) % 90 + 10 AS DOUBLE) AS length FROM (SELECT s_suppkey AS src, s_suppkey * 2 AS dst FROM supplier UNION ALL SELECT s_suppkey * 3, s_suppkey FROM supplier UNION ALL SELECT s_suppkey, s_suppkey + 17 FROM supplier) WHERE src % 7 <> 3)"


def _seed(spark: SparkSession) -> DataFrame:
    return spark.range(1, 2).select(F.col("id").alias("node"))


def reachability(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(_edges(spark, d), _seed(spark)).select("node", F.col("steps").cast("long").alias("steps"))


REACH = "r AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS steps UNION SELECT dst, steps + 1 FROM r JOIN ed ON src = node WHERE steps < (SELECT count(DISTINCT dst) FROM ed))"


def strong_set(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_set(_edges(spark, d), spark.range(20, 21).select(F.col("id").alias("node")))


STRONG_SQL = f"WITH RECURSIVE {EDGES}, f AS (SELECT CAST(20 AS BIGINT) AS node UNION SELECT dst FROM f JOIN ed ON src = node), b AS (SELECT CAST(20 AS BIGINT) AS node UNION SELECT src FROM b JOIN ed ON dst = node) SELECT node FROM f INTERSECT SELECT node FROM b"


def cut_off_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cut_off(_edges(spark, d), F.col("src") % 5 == 2, _seed(spark))


CUT_SQL = f"WITH RECURSIVE {EDGES}, f AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT dst FROM f JOIN ed ON src = node), b AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT dst FROM b JOIN ed ON src = node WHERE src % 5 <> 2) SELECT node FROM f EXCEPT SELECT node FROM b"


def dead_ends(spark: SparkSession, d: str) -> DataFrame:
    return graph.dead_ends(_edges(spark, d))


def street_blocks(spark: SparkSession, d: str) -> DataFrame:
    return graph.blocks(_edges(spark, d))


BLOCKS_SQL = f"WITH RECURSIVE {EDGES}, e2 AS (SELECT src AS u, dst AS v FROM ed UNION SELECT dst, src FROM ed), r AS (SELECT DISTINCT u AS node, u AS root FROM e2 UNION SELECT v, root FROM r JOIN e2 ON u = node) SELECT node, min(root) AS block FROM r GROUP BY 1"


def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.extra_distance(_edges(spark, d), F.col("src") % 5 == 2, _seed(spark))


PATHS_SQL = f"""WITH RECURSIVE {EDGES}, f AS (SELECT CAST(1 AS BIGINT) AS node, 0.0::DOUBLE AS d, 0 AS n UNION SELECT node, min(d) AS d, n FROM (SELECT dst AS node, d + length AS d, n + 1 AS n FROM f JOIN ed ON src = node WHERE n < (SELECT count(DISTINCT dst) FROM ed)) GROUP BY node, n),
g AS (SELECT CAST(1 AS BIGINT) AS node, 0.0::DOUBLE AS d, 0 AS n UNION SELECT node, min(d) AS d, n FROM (SELECT dst AS node, d + length AS d, n + 1 AS n FROM g JOIN ed ON src = node WHERE n < (SELECT count(DISTINCT dst) FROM ed) AND src % 5 <> 2) GROUP BY node, n),
a AS (SELECT node, min(d) AS open_m FROM f GROUP BY 1), b AS (SELECT node, min(d) AS closed_m FROM g GROUP BY 1) SELECT a.node, open_m, closed_m FROM a LEFT JOIN b ON a.node = b.node"""


def best_hub(spark: SparkSession, d: str) -> DataFrame:
    return graph.best_hub(_edges(spark, d))


HUB_SQL = f"WITH RECURSIVE {EDGES}, l AS (SELECT DISTINCT src FROM (SELECT src FROM ed ORDER BY length DESC, src, dst LIMIT 12)), r AS (SELECT src AS seed, src AS node FROM l UNION SELECT seed, dst FROM r JOIN ed ON src = node) SELECT seed AS node, count(*) AS reached FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"


def replicated(spark: SparkSession, d: str) -> DataFrame:
    """Replication keeps one original per vehicle; the copies' jitter stays within its bounds."""
    v = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1000.0).alias("depart"))
    r = graph.replicate(v, 4)
    return r.groupBy("copy").agg(F.count("*").alias("n"), F.sum(F.when(F.abs(F.col("depart") - 1000) <= 150, 0).otherwise(1)).alias("n_outside"), F.max(F.when(F.col("copy") == 0, F.col("depart"))).alias("own_depart"))


def signed_detours(spark: SparkSession, d: str) -> DataFrame:
    li = t.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("pos"), (F.col("l_partkey") % 50).alias("edge"))
    r = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", "edge"))).alias("rest")).select(F.col("l_orderkey").alias("id"), "rest")
    det = spark.range(0, 50, 2).select(F.col("id").alias("edge"), (F.pmod(F.col("id") * 37, F.lit(400)) + 200).cast("double").alias("length"))
    return graph.signed_detours(r, det)


DETOUR_SQL = "WITH m AS (SELECT l_orderkey AS id, CAST(l_linenumber AS INTEGER) AS pos, l_partkey % 50 AS edge, CAST((l_partkey % 50) * 37 % 400 + 200 AS DOUBLE) AS length FROM lineitem WHERE l_partkey % 50 % 2 = 0), f AS (SELECT *, min(length) OVER (PARTITION BY id) AS best FROM m) SELECT id, pos, edge, length FROM f WHERE length <= best + 100 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, length) = 1"

QUERIES = {
    "paired_run_delay": (paired_run_delay, PAIRED + " SELECT seed, round(sum(diff) / 3600, 6) AS delay_veh_h, count(*) AS n_trips FROM p GROUP BY 1"),
    "seed_spread": (seed_spread, f"WITH {TRIPS}, x AS (SELECT \"case\", seed, sum(duration) AS v FROM trips GROUP BY 1, 2) SELECT \"case\", round_even(min(v), 0) AS low, round_even(median(v), 0) AS typical, round_even(max(v), 0) AS high FROM x GROUP BY 1"),
    "noise_floor": (noise_floor, NOISE_SQL),
    "geh_calibration": (geh_calibration, f"WITH {COUNTS} SELECT hour, count(*) AS n, round(avg(CAST(geh < 5 AS DOUBLE)), 6) AS share_under_5, round(avg(CAST(geh < 10 AS DOUBLE)), 6) AS share_under_10, round(avg(geh), 6) AS mean_geh, round(sum(counted), 2) AS counted, round(sum(simulated), 2) AS simulated FROM g GROUP BY 1"),
    "worst_edges": (worst_edges, f"WITH {COUNTS} SELECT edge, round(sum(abs(simulated - counted)), 3) AS abs_error FROM g GROUP BY 1 ORDER BY sum(abs(simulated - counted)) DESC, edge LIMIT 12"),
    "proportional_allocation": (proportional_allocation, "SELECT o_orderkey, round(1000 * (o_orderkey % 4 + 1) / sum(o_orderkey % 4 + 1) OVER (PARTITION BY c_nationkey), 6) AS allocated FROM orders JOIN customer ON o_custkey = c_custkey"),
    "street_changes": (street_changes, STREETS_SQL),
    "closed_edge_users": (closed_edge_users, USERS_SQL),
    "route_density": (route_density, "SELECT l_partkey % 50 AS edge, count(DISTINCT (l_orderkey, l_linenumber)) / 5.0::DOUBLE AS users_per_seed FROM lineitem GROUP BY 1"),
    "gap_tolerant_runs": (gap_tolerant_runs, RUNS_SQL),
    "pinch_pairs": (pinch_pairs, PINCH_SQL),
    "until_first_bad": (until_first_bad, f"WITH {USER_HOURS} SELECT user_id, coalesce(min(CASE WHEN value > 95 THEN bin END), max(bin) + 1) AS until FROM u GROUP BY 1"),
    "half_hour_interpolation": (half_hour_interpolation, HALF_SQL),
    "trailing_mean": (trailing_mean, TRAILING_SQL),
    "running_distinct": (running_distinct, RUNNING_SQL),
    "reachability": (reachability, f"WITH RECURSIVE {EDGES}, {REACH} SELECT node, min(steps) AS steps FROM r GROUP BY 1"),
    "strong_set": (strong_set, STRONG_SQL),
    "cut_off_edges": (cut_off_edges, CUT_SQL),
    "dead_ends": (dead_ends, f"WITH {EDGES} SELECT dst AS node FROM ed EXCEPT SELECT src FROM ed"),
    "street_blocks": (street_blocks, BLOCKS_SQL),
    "shortest_paths": (shortest_paths, PATHS_SQL),
    "best_hub": (best_hub, HUB_SQL),
    "replicated_vehicles": (replicated, "SELECT CAST(c AS INTEGER) AS copy, count(*) AS n, 0::BIGINT AS n_outside, CASE WHEN c = 0 THEN 1000.0::DOUBLE END AS own_depart FROM orders, (SELECT unnest(range(4)) AS c) GROUP BY c"),
    "signed_detours": (signed_detours, DETOUR_SQL),
}
