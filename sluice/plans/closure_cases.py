"""Two closure cases against normal runs: delays, streets, legs and the record of a report.

Line items are trips: the return flag tells the case, the line number the seed, the part the trip and its hour; suppliers are
the edges on its route.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases, graph, sections
from . import tables as t

CASES = ["closure", "signed"]
CLOSED = [3, 4]
LEAST = 0.001
CAPACITY = 20.0


def _lines(spark: SparkSession, d: str) -> DataFrame:
    case = F.when(F.col("l_returnflag") == "A", "base").when(F.col("l_returnflag") == "N", "closure").otherwise("signed")
    return t.table(spark, d, "lineitem").select(case.alias("case"), (F.col("l_partkey") % 3 + 7).alias("hour"), F.col("l_linenumber").cast("int").alias("seed"), F.col("l_partkey").alias("trip"), (F.col("l_suppkey") % 25).alias("edge"), F.month("l_shipdate").alias("begin"), "l_quantity", F.floor("l_extendedprice").cast("double").alias("price"), F.round(F.col("l_discount") * 100).alias("discount"), F.round(F.col("l_tax") * 100).alias("tax"))


LINES = """l AS (SELECT CASE l_returnflag WHEN 'A' THEN 'base' WHEN 'N' THEN 'closure' ELSE 'signed' END AS "case", l_partkey % 3 + 7 AS hour, CAST(l_linenumber AS INTEGER) AS seed, l_partkey AS trip, l_suppkey % 25 AS edge, month(l_shipdate) AS "begin", l_quantity, floor(l_extendedprice) AS price, round(l_discount * 100) AS discount, round(l_tax * 100) AS tax FROM lineitem)"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """trips, routes, flows, jams and health."""
    x = _lines(spark, d)
    run = ["case", "hour", "seed"]
    trips = x.groupBy(*run, "trip").agg(F.sum("l_quantity").alias("seconds"), F.sum("price").alias("metres"))
    routes = x.groupBy(*run, "trip").agg(F.sort_array(F.collect_set("edge")).alias("edges"))
    flows = x.groupBy(*run, "edge").agg(F.count("*").cast("double").alias("entered"), F.sum("discount").alias("seconds"))
    jams = x.groupBy(*run, "edge", "begin").agg(F.max("l_quantity").alias("jam_m"))
    health = x.groupBy(*run).agg(F.count("*").alias("loaded"), F.count_if(F.col("discount") == 10).alias("discarded"), F.count_if(F.col("tax") == 8).alias("teleports"))
    return trips, routes, flows, jams, health


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """sections and legs of the edges that suppliers name."""
    e = t.table(spark, d, "supplier").select((F.col("s_suppkey") % 25).alias("edge")).distinct()
    lanes = (1 + F.col("edge") % 3).alias("lanes")
    leg = F.col("edge") % 4
    return e.select((F.col("edge") % 9).alias("section"), "edge", lanes), e.where("edge < 20").select(leg.alias("leg"), F.when(leg == 0, "detour").otherwise("approach").alias("role"), "edge", lanes)


PARTS = "e AS (SELECT DISTINCT s_suppkey % 25 AS edge FROM supplier), sec AS (SELECT edge % 9 AS section, edge, 1 + edge % 3 AS lanes FROM e), leg AS (SELECT edge % 4 AS leg, CASE edge % 4 WHEN 0 THEN 'detour' ELSE 'approach' END AS role, edge, 1 + edge % 3 AS lanes FROM e WHERE edge < 20)"
KINDS = """k AS (SELECT unnest(['closure', 'signed']) AS "case")"""


def _delays(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    trips, routes, *_ = _runs(spark, d)
    pairs = cases.compared(trips, cases.base_users(routes, CLOSED))
    return cases.delays(pairs), cases.per_trip(pairs)


def case_delays(spark: SparkSession, d: str) -> DataFrame:
    delay, trip = _delays(spark, d)
    out = delay.join(trip, "case")
    flat = lambda s: [F.col(f"{s}.{k}").alias(f"{s}_{k}") for k in ("low", "typical", "high")]
    plain = [c for c, kind in out.dtypes if not kind.startswith("struct")]
    return out.select(*plain, *[c for s in ("all_traffic", "diverted", "mean_across_seeds", "extra_metres") for c in flat(s)])


def _rank(p: float, x: str) -> str:
    """The value at index min(n - 1, floor(p n))."""
    return f"list_extract(list(CAST({x} AS DOUBLE) ORDER BY {x}), CAST(least(count(*) - 1, floor({p} * count(*))) AS BIGINT) + 1)"


PAIRS = f"""{LINES}, trips AS (SELECT "case", hour, seed, trip, sum(l_quantity) AS s, sum(price) AS m FROM l GROUP BY ALL),
users AS (SELECT DISTINCT hour, seed, trip FROM l WHERE "case" = 'base' AND edge IN (3, 4)),
b AS (SELECT t.*, u.trip IS NOT NULL AS used FROM trips t LEFT JOIN users u ON u.hour = t.hour AND u.seed = t.seed AND u.trip = t.trip WHERE "case" = 'base'),
nx AS (SELECT seed, lead(seed) OVER (ORDER BY seed) AS nxt FROM (SELECT DISTINCT seed FROM b)),
pairs AS (SELECT c."case", c.seed, b.used, c.s - b.s AS xs, c.m - b.m AS xm FROM trips c JOIN b ON b.hour = c.hour AND b.seed = c.seed AND b.trip = c.trip WHERE c."case" <> 'base'
UNION ALL SELECT 'noise', b.seed, b.used, c.s - b.s, c.m - b.m FROM b JOIN nx ON nx.seed = b.seed JOIN b c ON c.seed = nx.nxt AND c.hour = b.hour AND c.trip = b.trip)"""
DELAYS_SQL = f"""WITH {PAIRS}, seeds AS (SELECT "case", seed, sum(xs) / 3600 AS a, coalesce(sum(xs) FILTER (used), 0) / 3600 AS u, avg(xs) FILTER (used) AS m FROM pairs GROUP BY ALL),
fl AS (SELECT max(abs(round_even(a, 1))) AS a, max(abs(round_even(u, 1))) AS u FROM seeds WHERE "case" = 'noise'),
d AS (SELECT "case", round_even(min(a), 1) AS al, round_even(median(a), 1) AS aty, round_even(max(a), 1) AS ah, round_even(min(u), 1) AS ul, round_even(median(u), 1) AS ut, round_even(max(u), 1) AS uh, round_even(min(m), 0) AS ml, round_even(median(m), 0) AS mt, round_even(max(m), 0) AS mh FROM seeds WHERE "case" <> 'noise' GROUP BY 1),
t AS (SELECT "case", round_even({_rank(0.25, 'xs')}, 0) AS lower_quartile, round_even(median(xs), 0) AS median, round_even({_rank(0.75, 'xs')}, 0) AS upper_quartile, round_even(avg(xs), 0) AS mean, count(*) AS trips_compared, greatest(0, round_even({_rank(0.25, 'xm')}, 0)) AS xl, greatest(0, round_even({_rank(0.5, 'xm')}, 0)) AS xt, greatest(0, round_even({_rank(0.75, 'xm')}, 0)) AS xh FROM pairs WHERE used AND "case" <> 'noise' GROUP BY 1)
SELECT d."case", fl.a AS all_traffic_floor, fl.u AS diverted_floor, al <= 0 OR abs(aty) <= fl.a AS all_traffic_is_noise, ul <= 0 OR abs(ut) <= fl.u AS diverted_is_noise, lower_quartile, median, upper_quartile, mean, trips_compared, al AS all_traffic_low, aty AS all_traffic_typical, ah AS all_traffic_high, ul AS diverted_low, ut AS diverted_typical, uh AS diverted_high, ml AS mean_across_seeds_low, mt AS mean_across_seeds_typical, mh AS mean_across_seeds_high, xl AS extra_metres_low, xt AS extra_metres_typical, xh AS extra_metres_high FROM d JOIN t ON t."case" = d."case" CROSS JOIN fl"""


def _streets(spark: SparkSession, d: str) -> DataFrame:
    _, routes, flows, _, _ = _runs(spark, d)
    sec, _ = _parts(spark, d)
    gains = cases.section_gains(routes, cases.base_users(routes, CLOSED), sec, CASES, 7)
    works = sections.diverted(flows.where("case = 'base'"), CLOSED)
    least = LEAST * works.select("typical").scalar()
    return cases.streets(gains, cases.fullest(flows, sec, "section", CASES, CAPACITY), least, sec.where(F.col("edge").isin(*CLOSED)))


def case_streets(spark: SparkSession, d: str) -> DataFrame:
    return _streets(spark, d).select("case", "kind", "place", "section", F.round("drivers", 6).alias("drivers"), "edge", "lanes", F.round("normal", 6).alias("normal"), F.round("with_closure", 6).alias("with_closure"), "peak", F.round("share", 6).alias("share"), "verdict")


def _full(part: str, src: str) -> str:
    return f"""SELECT k."case", p.{part}, p.edge, p.lanes, coalesce(n.w, 0) AS normal, coalesce(c.w, 0) AS with_closure, coalesce(c.p, 0) AS peak, coalesce(c.p, 0) / (p.lanes * {CAPACITY}) AS share FROM {src} p CROSS JOIN k LEFT JOIN fm n ON n."case" = 'base' AND n.edge = p.edge LEFT JOIN fm c ON c."case" = k."case" AND c.edge = p.edge QUALIFY row_number() OVER (PARTITION BY k."case", p.{part} ORDER BY share DESC, p.edge) = 1"""


FLOWS = """flows AS (SELECT "case", hour, seed, edge, CAST(count(*) AS DOUBLE) AS entered, sum(discount) AS seconds FROM l GROUP BY ALL), fm AS (SELECT "case", edge, avg(entered) AS w, max(entered) AS p FROM flows GROUP BY ALL)"""
STREETS_SQL = f"""WITH {PAIRS}, {PARTS}, {KINDS}, {FLOWS},
su AS (SELECT "case", section, count(*) AS n FROM (SELECT DISTINCT l."case", l.hour, l.seed, l.trip, sec.section FROM l JOIN users u ON u.hour = l.hour AND u.seed = l.seed AND u.trip = l.trip JOIN sec ON sec.edge = l.edge) GROUP BY ALL),
g AS (SELECT k."case", s.section, (coalesce(c.n, 0) - coalesce(b.n, 0)) / 7 AS gain FROM (SELECT DISTINCT section FROM su) s CROSS JOIN k LEFT JOIN su b ON b."case" = 'base' AND b.section = s.section LEFT JOIN su c ON c."case" = k."case" AND c.section = s.section),
di AS (SELECT round_even(median(n), 0) AS typical FROM (SELECT seed, sum(n) AS n FROM (SELECT seed, hour, max(entered) AS n FROM flows WHERE "case" = 'base' AND edge IN (3, 4) GROUP BY ALL) GROUP BY 1)),
full_ AS ({_full('section', 'sec')}),
u AS (SELECT "case", 'taking' AS kind, section, gain AS drivers FROM g, di WHERE gain >= {LEAST} * typical UNION ALL SELECT "case", 'relieved', section, -gain FROM g, di WHERE -gain >= {LEAST} * typical AND section NOT IN (3, 4)),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY "case", kind ORDER BY drivers DESC, section) AS INTEGER) AS place FROM u)
SELECT top."case", kind, place, top.section, round(drivers, 6) AS drivers, f.edge, f.lanes, round(f.normal, 6) AS normal, round(f.with_closure, 6) AS with_closure, f.peak, round(f.share, 6) AS share, CASE WHEN f.share < 0.6 THEN 'well within capacity' WHEN f.share < 0.85 THEN 'busy' WHEN f.share >= 0.85 THEN 'near or over capacity' END AS verdict
FROM top LEFT JOIN full_ f ON f."case" = top."case" AND f.section = top.section AND kind = 'taking' WHERE place <= CASE kind WHEN 'taking' THEN 8 ELSE 5 END"""


def _legs(spark: SparkSession, d: str) -> DataFrame:
    _, _, flows, jams, health = _runs(spark, d)
    _, legs = _parts(spark, d)
    return cases.leg_cases(legs, cases.leg_runs(legs, jams, flows, health), cases.fullest(flows, legs, "leg", CASES, CAPACITY), CASES)


def case_legs(spark: SparkSession, d: str) -> DataFrame:
    x = _legs(spark, d)
    return x.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in x.dtypes])


LEGS = f"""{LINES}, {PARTS}, {KINDS}, {FLOWS}, runs AS (SELECT DISTINCT "case", hour, seed FROM l), ln AS (SELECT DISTINCT leg, role FROM leg),
q AS (SELECT "case", hour, seed, leg, max(j) AS j FROM (SELECT "case", hour, seed, leg, "begin", sum(j) AS j FROM (SELECT "case", hour, seed, edge, "begin", max(l_quantity) AS j FROM l GROUP BY ALL) x JOIN leg ON leg.edge = x.edge GROUP BY ALL) GROUP BY ALL),
s AS (SELECT "case", hour, seed, leg, sum(seconds) AS s FROM flows JOIN leg ON leg.edge = flows.edge GROUP BY ALL),
r AS (SELECT runs."case", runs.hour, runs.seed, ln.leg, coalesce(j, 0) AS queue, coalesce(s, 0) AS secs FROM runs CROSS JOIN ln LEFT JOIN q ON q."case" = runs."case" AND q.hour = runs.hour AND q.seed = runs.seed AND q.leg = ln.leg LEFT JOIN s ON s."case" = runs."case" AND s.hour = runs.hour AND s.seed = runs.seed AND s.leg = ln.leg),
a AS (SELECT "case", leg, median(queue) AS typical, max(queue) AS worst, avg(secs) AS secs, {_rank(0.25, 'queue')} AS low FROM r GROUP BY ALL),
no AS (SELECT leg, coalesce(median(x), 0) AS noise FROM (SELECT leg, abs(queue - lag(queue) OVER (PARTITION BY leg, hour ORDER BY seed)) AS x FROM r WHERE "case" = 'base') GROUP BY 1),
full_ AS ({_full('leg', 'leg')}),
rep AS (SELECT c."case", c.leg, c.typical AS closure_typical, c.worst AS closure_worst, c.secs AS closure_seconds, c.low AS queue_low, b.typical AS normal_typical, b.worst AS normal_worst, b.secs AS normal_seconds, no.noise, c.typical - b.typical > no.noise AND c.typical - b.typical >= 5 AS grows, f.edge, f.lanes, f.normal, f.with_closure, f.peak, f.share, ln.role FROM a c JOIN a b ON b."case" = 'base' AND b.leg = c.leg JOIN no ON no.leg = c.leg JOIN full_ f ON f."case" = c."case" AND f.leg = c.leg JOIN ln ON ln.leg = c.leg WHERE c."case" <> 'base')"""
LEGS_SQL = f"""WITH {LEGS} SELECT "case", leg, role, edge, lanes, grows, {', '.join(f'round({c}, 6) AS {c}' for c in ('closure_typical', 'closure_worst', 'closure_seconds', 'queue_low', 'normal_typical', 'normal_worst', 'normal_seconds', 'noise', 'normal', 'with_closure', 'peak', 'share'))} FROM rep"""


def case_records(spark: SparkSession, d: str) -> DataFrame:
    """The nested records, read back: a leg of a case in a row, with what its record says of the whole case."""
    delay, trip = _delays(spark, d)
    r = cases.records(delay, trip, _streets(spark, d), _legs(spark, d), _runs(spark, d)[4])
    one = r.select("case", F.col("delay.diverted.typical").alias("delay"), F.col("extra_seconds.median").alias("median"), F.col("extra_metres.high").alias("metres"), F.col("health.max_dropped_share").alias("dropped"), F.col("health.max_teleports").alias("teleports"), F.col("max_queue.leg").alias("longest"), F.col("max_queue.high").alias("longest_m"), F.size("streets_taking").cast("long").alias("n_taking"), F.size("streets_relieved").cast("long").alias("n_relieved"), F.explode("legs").alias("l"))
    return one.select("*", F.col("l.leg").alias("leg"), F.col("l.queue.closure_worst").alias("worst"), F.col("l.queue.grows").alias("grows"), F.col("l.seconds.normal_seconds").alias("seconds")).drop("l")


RECORDS_SQL = f"""WITH dl AS ({DELAYS_SQL}), st AS ({STREETS_SQL}), {LEGS},
h AS (SELECT "case", round_even(max(x), 4) AS dropped, max(t) AS teleports FROM (SELECT "case", hour, seed, count(*) FILTER (discount = 10) / count(*) AS x, count(*) FILTER (tax = 8) AS t FROM l GROUP BY ALL) GROUP BY 1),
mq AS (SELECT "case", leg, round_even(closure_worst, 0) AS m FROM rep WHERE grows QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY closure_typical DESC, leg) = 1),
n AS (SELECT "case", count(*) FILTER (kind = 'taking') AS n_taking, count(*) FILTER (kind = 'relieved') AS n_relieved FROM st GROUP BY 1)
SELECT rep."case", dl.diverted_typical AS delay, dl.median, dl.extra_metres_high AS metres, h.dropped, h.teleports, mq.leg AS longest, mq.m AS longest_m, coalesce(n_taking, 0) AS n_taking, coalesce(n_relieved, 0) AS n_relieved, rep.leg, round_even(closure_worst, 0) AS worst, grows, round_even(normal_seconds, 0) AS seconds
FROM rep JOIN dl ON dl."case" = rep."case" JOIN h ON h."case" = rep."case" LEFT JOIN mq ON mq."case" = rep."case" LEFT JOIN n ON n."case" = rep."case\""""


def block_queue_levels(spark: SparkSession, d: str) -> DataFrame:
    """Events as cars that queue on a block (their user's remainder), a second for each quarter of an hour; errors are the normal runs."""
    e = t.table(spark, d, "events")
    case = F.when(F.col("event_type") == "error", "base").when(F.col("event_type").isin("click", "view"), "closure").otherwise("signed")
    second = F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)
    q = e.groupBy(case.alias("case"), (F.col("user_id") % 10).alias("block"), second.cast("int").alias("second")).agg(F.count("*").cast("double").alias("cars"))
    out = cases.block_levels(q, CASES, 24, 96, 8)
    return out.select("case", "block", "second", F.round("queue", 6).alias("queue"), F.round("normal", 6).alias("normal"), "level")


LEVELS_SQL = """WITH q AS (SELECT CASE WHEN event_type = 'error' THEN 'base' WHEN event_type IN ('click', 'view') THEN 'closure' ELSE 'signed' END AS "case", user_id % 10 AS block, CAST(hour(ts) * 4 + minute(ts) // 15 AS INTEGER) AS second, CAST(count(*) AS DOUBLE) AS cars FROM events GROUP BY ALL),
near AS (SELECT * FROM q WHERE second BETWEEN 16 AND 95), g AS (SELECT k."case", b.block, CAST(s.second AS INTEGER) AS second FROM (SELECT DISTINCT block FROM near) b CROSS JOIN (SELECT unnest(['base', 'closure', 'signed']) AS "case") k CROSS JOIN (SELECT unnest(range(16, 96)) AS second) s),
x AS (SELECT g.*, coalesce(cars, 0) AS cars FROM g LEFT JOIN near ON near."case" = g."case" AND near.block = g.block AND near.second = g.second),
y AS (SELECT *, avg(cars) OVER (PARTITION BY "case", block ORDER BY second ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS queue FROM x),
n AS (SELECT block, sum(cars) / 72 AS normal FROM near WHERE "case" = 'base' AND second >= 24 GROUP BY 1),
z AS (SELECT y.*, coalesce(normal, 0) AS normal FROM y LEFT JOIN n ON n.block = y.block WHERE second >= 24)
SELECT "case", block, second, round(queue, 6) AS queue, round(normal, 6) AS normal, CAST(CASE WHEN queue - normal < 2 THEN 0 ELSE (queue - normal >= 0.2 * normal)::INT + (queue - normal >= 0.5 * normal)::INT + (queue - normal >= normal)::INT END AS INTEGER) AS level FROM z"""


def closure_demands(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sampled trips over their suppliers; the edges of pending ones cannot be rerouted, open ones have a signed way."""
    x = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", (F.col("l_suppkey") % 25).alias("edge"))
    trips = x.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "edge"))).alias("e")).select("id", F.col("e.edge").alias("edges"))
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    way = trips.join(o, "id")
    free = F.filter("edges", lambda e: ~e.isin(*CLOSED))
    rerouted = way.where("o_orderstatus <> 'P'").select("id", free.alias("edges"))
    signed = way.where("o_orderstatus = 'O'").select("id", F.transform("edges", lambda e: F.when(e.isin(*CLOSED), e + 100).otherwise(e)).alias("edges"))
    out = graph.demands(trips, CLOSED, rerouted, signed)
    return out.select("case", "id", F.array_join(F.col("edges").cast("array<string>"), " ").alias("edges"))


DEMANDS_SQL = """WITH x AS (SELECT l_orderkey AS id, l_linenumber AS n, l_suppkey % 25 AS edge, l_suppkey % 25 IN (3, 4) AS shut FROM lineitem),
t AS (SELECT id, bool_or(shut) AS used, string_agg(edge, ' ' ORDER BY n, edge) AS edges, coalesce(string_agg(edge, ' ' ORDER BY n, edge) FILTER (NOT shut), '') AS free, string_agg(edge + CASE WHEN shut THEN 100 ELSE 0 END, ' ' ORDER BY n, edge) AS signed FROM x GROUP BY 1),
k AS (SELECT t.*, o_orderstatus AS s FROM t LEFT JOIN orders ON o_orderkey = id WHERE NOT used OR o_orderstatus <> 'P')
SELECT 'base' AS "case", id, edges FROM k UNION ALL SELECT 'closure', id, CASE WHEN used THEN free ELSE edges END FROM k UNION ALL SELECT 'signed', id, CASE WHEN used AND s = 'O' THEN signed WHEN used THEN free ELSE edges END FROM k"""


QUERIES = {
    "case_delays": (case_delays, DELAYS_SQL),
    "case_streets": (case_streets, STREETS_SQL),
    "case_legs": (case_legs, LEGS_SQL),
    "case_records": (case_records, RECORDS_SQL),
    "closure_demands": (closure_demands, DEMANDS_SQL),
    "block_queue_levels": (block_queue_levels, LEVELS_SQL),
}
