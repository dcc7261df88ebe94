"""Named streets: closed edges, block sections, and the site report's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import demand, queue, sections
from . import tables as t


def _streets(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' keys as a street network: streets A run north in steps of 17, streets B double the key, some of the links have no name."""
    s = F.col("s_suppkey")
    edge = lambda kind, src, dst, name, way: F.struct(F.concat(F.lit(kind), s.cast("string")).alias("edge"), src.alias("src"), dst.alias("dst"), name.alias("name"), F.lit(way).alias("way"))
    b = F.when(s % 4 == 0, F.concat(F.lit("B"), (s % 5).cast("string"))).otherwise("")
    kinds = F.array(edge("n", s, s + 17, F.concat(F.lit("A"), (s % 17).cast("string")), "northbound"), edge("s", s + 17, s, F.when(s % 3 != 0, F.concat(F.lit("A"), (s % 17).cast("string"))).otherwise(""), "southbound"), edge("e", s, s * 2, b, "eastbound"))
    return t.table(spark, d, "supplier").select(F.inline(kinds))


STREETS = """ed AS MATERIALIZED (SELECT 'n' || s_suppkey AS edge, s_suppkey AS src, s_suppkey + 17 AS dst, 'A' || s_suppkey % 17 AS name, 'northbound' AS way FROM supplier
UNION ALL SELECT 's' || s_suppkey, s_suppkey + 17, s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN 'A' || s_suppkey % 17 ELSE '' END, 'southbound' FROM supplier
UNION ALL SELECT 'e' || s_suppkey, s_suppkey, s_suppkey * 2, CASE WHEN s_suppkey % 4 = 0 THEN 'B' || s_suppkey % 5 ELSE '' END, 'eastbound' FROM supplier)"""


def block_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.block_sections(_streets(spark, d))


SECTIONS = STREETS + """, cnt AS MATERIALIZED (SELECT node, name, count(*) AS n FROM (SELECT src AS node, name FROM ed UNION ALL SELECT dst, name FROM ed) WHERE name <> '' GROUP BY 1, 2),
w0 AS MATERIALIZED (SELECT edge, name, way, 'ahead' AS side, src AS a, dst AS b FROM ed WHERE name <> '' UNION ALL SELECT edge, name, way, 'behind', dst, src FROM ed WHERE name <> ''),
nx AS MATERIALIZED (SELECT x.edge, x.side, min(y.edge) AS nxt FROM w0 x JOIN w0 y ON y.side = x.side AND y.name = x.name AND y.way = x.way AND y.a = x.b GROUP BY 1, 2),
st AS MATERIALIZED (SELECT x.*, nx.nxt, EXISTS (SELECT 1 FROM cnt WHERE cnt.node = x.b AND cnt.name <> x.name) AS hit FROM w0 x LEFT JOIN nx ON nx.edge = x.edge AND nx.side = x.side),
walk AS (SELECT edge, side, edge AS cur, 1 AS step FROM w0 UNION ALL SELECT w.edge, w.side, st.nxt, step + 1 FROM walk w JOIN st ON st.edge = w.cur AND st.side = w.side WHERE NOT st.hit AND st.nxt IS NOT NULL AND step < 15),
fin AS MATERIALIZED (SELECT w.edge, w.side, st.b AS node, st.name, st.hit, st.nxt FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY edge, side ORDER BY step DESC) = 1) w JOIN st ON st.edge = w.cur AND st.side = w.side),
un AS MATERIALIZED (SELECT DISTINCT u, v FROM (SELECT src AS u, dst AS v FROM ed WHERE name = '' UNION ALL SELECT dst, src FROM ed WHERE name = '') WHERE u <> v),
ring AS (SELECT DISTINCT node, name, node AS cur, 0 AS r FROM fin WHERE NOT hit AND nxt IS NULL UNION SELECT node, name, v, r + 1 FROM ring JOIN un ON u = cur WHERE r < 3),
near AS (SELECT node, name, cur, min(r) AS r FROM ring GROUP BY 1, 2, 3),
met AS (SELECT near.node, near.name, near.r, cnt.name AS other, sum(n) AS n FROM near JOIN cnt ON cnt.node = near.cur AND cnt.name <> near.name GROUP BY 1, 2, 3, 4),
thr AS (SELECT node, name, other FROM met QUALIFY row_number() OVER (PARTITION BY node, name ORDER BY r, n DESC, other) = 1),
dir AS (SELECT f.edge, f.side, c.name AS other FROM fin f JOIN cnt c ON c.node = f.node AND c.name <> f.name WHERE f.hit QUALIFY row_number() OVER (PARTITION BY f.edge, f.side ORDER BY c.n DESC, c.name) = 1),
ends AS (SELECT * FROM dir UNION ALL SELECT f.edge, f.side, thr.other FROM fin f JOIN thr ON thr.node = f.node AND thr.name = f.name WHERE NOT f.hit AND f.nxt IS NULL),
sec AS (SELECT ed.edge, ed.name, ed.way, coalesce(max(CASE WHEN side = 'behind' THEN other END), 'the edge of the study area') AS behind, coalesce(max(CASE WHEN side = 'ahead' THEN other END), 'the edge of the study area') AS ahead FROM ed LEFT JOIN ends ON ends.edge = ed.edge WHERE ed.name <> '' GROUP BY 1, 2, 3)
SELECT * FROM sec WHERE behind <> ahead"""


def edges_beside(spark: SparkSession, d: str) -> DataFrame:
    """Customers as edges of streets named after their segment; nations as lines."""
    k = F.col("c_custkey")
    e = t.table(spark, d, "customer").select(k.alias("edge"), F.col("c_mktsegment").alias("name"), F.when(k % 2 == 0, "northbound").otherwise("southbound").alias("way"), (k * 37 % 1000).cast("double").alias("mx"), (k * 91 % 1000).cast("double").alias("my"))
    n = F.col("n_nationkey")
    lines = t.table(spark, d, "nation").select(n.alias("line"), F.element_at(F.array(*[F.lit(x) for x in SEGMENTS]), (n % 5 + 1).cast("int")).alias("name"), F.when(n % 2 == 0, "northbound").otherwise("southbound").alias("way"), (n * 30).cast("double").alias("x1"), (n * 20).cast("double").alias("y1"), (900 - n * 10).cast("double").alias("x2"), (400 + n * 16).cast("double").alias("y2"))
    return sections.edges_along(e, lines).select("line", "edge", F.col("place").cast("long").alias("place"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
BESIDE_SQL = """WITH e AS (SELECT c_custkey AS edge, c_mktsegment AS name, c_custkey % 2 AS way, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS mx, CAST(c_custkey * 91 % 1000 AS DOUBLE) AS my FROM customer),
l AS (SELECT n_nationkey AS line, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][CAST(n_nationkey % 5 + 1 AS INTEGER)] AS name, n_nationkey % 2 AS way, n_nationkey * 30.0::DOUBLE AS x1, n_nationkey * 20.0::DOUBLE AS y1, 900 - n_nationkey * 10.0::DOUBLE AS x2, 400 + n_nationkey * 16.0::DOUBLE AS y2 FROM nation),
m AS (SELECT line, edge, ((mx - x1) * (x2 - x1) + (my - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS t, abs((mx - x1) * (y2 - y1) - (my - y1) * (x2 - x1)) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS off FROM e JOIN l USING (name, way))
SELECT line, edge, row_number() OVER (PARTITION BY line ORDER BY t, edge) AS place FROM m WHERE t BETWEEN 0 AND 1 AND off <= 25"""


def closed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sites: the edges of street A at their junction that lead to a junction with the street B of their remainder."""
    s = F.col("s_suppkey")
    sites = t.table(spark, d, "supplier").select(s.alias("site"), s.alias("node"), F.concat(F.lit("A"), (s % 17).cast("string")).alias("street"), F.concat(F.lit("B"), (s % 5).cast("string")).alias("cross"))
    return sections.closed_between(_streets(spark, d), sites)


CLOSED_SQL = f"""WITH {STREETS}, en AS (SELECT edge, name, src AS node, dst AS far FROM ed UNION ALL SELECT edge, name, dst, src FROM ed), tc AS (SELECT src AS far, name FROM ed UNION SELECT dst, name FROM ed)
SELECT DISTINCT s_suppkey AS site, edge FROM supplier JOIN en ON en.node = s_suppkey AND en.name = 'A' || s_suppkey % 17 JOIN tc ON tc.far = en.far AND tc.name = 'B' || s_suppkey % 5"""


def _routes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as vehicles over their parts; their status tells the case."""
    o = t.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "base").otherwise("closure").alias("case"))
    r = t.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 200).alias("edges"))
    return r.join(o, r["l_orderkey"] == o["o_orderkey"]).select("case", F.col("o_orderkey").alias("vehicle"), "edges")


def _sections(spark: SparkSession) -> DataFrame:
    return spark.range(200).select(F.col("id").alias("edge"), (F.col("id") % 40).alias("section"), (F.col("id") % 3 + 1).alias("lanes"))


SECTION_USERS = "su AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'base' ELSE 'closure' END AS \"case\", l_partkey % 40 AS section, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def section_users(spark: SparkSession, d: str) -> DataFrame:
    return sections.section_users(_routes(spark, d), _sections(spark).drop("lanes"), ["case"], "vehicle")


def gaining_sections(spark: SparkSession, d: str) -> DataFrame:
    """The case's flows are lineitems of a month and line number on each part."""
    li = t.table(spark, d, "lineitem").withColumn("edge", F.col("l_partkey") % 200)
    flows = li.groupBy("edge", F.month("l_shipdate").alias("hour"), F.when(F.col("l_returnflag") == "R", "base").otherwise("closure").alias("case")).agg(F.sum("l_quantity").alias("entered"))
    out = sections.gaining(section_users(spark, d), flows.join(_sections(spark), "edge"), 5, 1.0)
    return out.select("section", F.round("gain", 4).alias("gain"), "edge", "lanes", *[F.round(c, 4).alias(c) for c in ("normal", "with_closure", "peak", "share")], "verdict")


GAINING_SQL = f"""WITH {SECTION_USERS}, g AS (SELECT section, sum(CASE "case" WHEN 'base' THEN -n ELSE n END) / 5.0::DOUBLE AS gain FROM su GROUP BY 1),
f AS (SELECT l_partkey % 200 AS edge, month(l_shipdate) AS hour, l_returnflag = 'R' AS base, sum(l_quantity) AS entered FROM lineitem GROUP BY 1, 2, 3),
x AS (SELECT edge, edge % 40 AS section, edge % 3 + 1 AS lanes, coalesce(avg(entered) FILTER (base), 0) AS normal, coalesce(avg(entered) FILTER (NOT base), 0) AS with_closure, coalesce(max(entered) FILTER (NOT base), 0) AS peak FROM f GROUP BY 1),
b AS (SELECT *, peak / (lanes * 800.0::DOUBLE) AS share FROM x QUALIFY row_number() OVER (PARTITION BY section ORDER BY peak / (lanes * 800.0::DOUBLE) DESC, edge) = 1)
SELECT section, round(gain, 4) AS gain, edge, lanes, round(normal, 4) AS normal, round(with_closure, 4) AS with_closure, round(peak, 4) AS peak, round(share, 4) AS share, CASE WHEN share < 0.6 THEN 'well within capacity' WHEN share < 0.85 THEN 'busy' ELSE 'near or over capacity' END AS verdict
FROM (SELECT * FROM g WHERE gain >= 1 ORDER BY gain DESC, section LIMIT 8) JOIN b USING (section)"""


def diverted_cars(spark: SparkSession, d: str) -> DataFrame:
    li = t.table(spark, d, "lineitem")
    counts = li.groupBy(F.col("l_linenumber").alias("seed"), F.month("l_shipdate").alias("hour"), (F.col("l_partkey") % 50).cast("string").alias("edge")).agg(F.sum("l_quantity").alias("entered"))
    return sections.diverted(counts, ["1", "7", "20"])


DIVERTED_SQL = "WITH c AS (SELECT l_linenumber AS seed, month(l_shipdate) AS hour, l_partkey % 50 AS edge, sum(l_quantity) AS n FROM lineitem WHERE l_partkey % 50 IN (1, 7, 20) GROUP BY 1, 2, 3), h AS (SELECT seed, hour, max(n) AS n FROM c GROUP BY 1, 2), s AS (SELECT seed, sum(n) AS n FROM h GROUP BY 1) SELECT round_even(min(n), 0) AS low, round_even(median(n), 0) AS typical, round_even(max(n), 0) AS high FROM s"


def extra_distance(spark: SparkSession, d: str) -> DataFrame:
    """Per return flag, the days by which lineitems were received after the commitment as extra metres of their trips."""
    late = t.table(spark, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 100 - F.col("l_quantity") * 10).alias("difference"))
    return sections.extra_distance(late, ["l_returnflag"])


EXTRA_SQL = "WITH x AS (SELECT l_returnflag, l_extendedprice / 100 - l_quantity * 10 AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice / 100 - l_quantity * 10) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, " + ", ".join(f"greatest(0.0::DOUBLE, round_even(max(v) FILTER (i = least(n - 1, CAST(floor({p}::DOUBLE * n) AS BIGINT))), 0)) AS {c}" for p, c in ((0.25, "low"), (0.5, "typical"), (0.75, "high"))) + ", max(n) AS n_trips FROM x GROUP BY 1"


def leg_report(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' nations as legs; months as hours, line numbers as seeds."""
    li = t.table(spark, d, "lineitem").select((F.col("l_suppkey") % 25).alias("leg"), F.month("l_shipdate").alias("hour"), F.col("l_linenumber").alias("seed"), F.when(F.col("l_returnflag") == "R", "base").otherwise("closure").alias("case"), "l_quantity", "l_tax")
    r = li.groupBy("leg", "hour", "seed", "case").agg(F.max("l_quantity").cast("double").alias("queue_m"), F.sum("l_quantity").cast("double").alias("seconds"))
    out = sections.leg_report(r, r.where("case = 'base'").select("leg", "seed", "hour", "queue_m"))
    return out.select("leg", "base_typical", "base_worst", F.round("base_seconds", 4).alias("base_seconds"), "closure_typical", "closure_worst", F.round("closure_seconds", 4).alias("closure_seconds"), "noise", "grows")


LEG_SQL = """WITH r AS (SELECT l_suppkey % 25 AS leg, month(l_shipdate) AS hour, l_linenumber AS seed, l_returnflag = 'R' AS base, CAST(max(l_quantity) AS DOUBLE) AS q, CAST(sum(l_quantity) AS DOUBLE) AS s FROM lineitem GROUP BY ALL),
a AS (SELECT leg, abs(q - lag(q) OVER (PARTITION BY leg, hour ORDER BY seed)) AS apart FROM r WHERE base), n AS (SELECT leg, coalesce(median(apart), 0) AS noise FROM a GROUP BY 1),
x AS (SELECT leg, median(q) FILTER (base) AS bt, max(q) FILTER (base) AS bw, avg(s) FILTER (base) AS bs, median(q) FILTER (NOT base) AS ct, max(q) FILTER (NOT base) AS cw, avg(s) FILTER (NOT base) AS cs FROM r GROUP BY 1)
SELECT x.leg, bt AS base_typical, bw AS base_worst, round(bs, 4) AS base_seconds, ct AS closure_typical, cw AS closure_worst, round(cs, 4) AS closure_seconds, coalesce(noise, 0) AS noise, ct - bt > coalesce(noise, 0) AND ct - bt >= 5 AS grows FROM x LEFT JOIN n ON n.leg = x.leg"""


def car_share(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sites: the returned part of what they shipped as the cars among all vehicles."""
    sites = t.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("cars"), F.sum("l_quantity").alias("all"))
    return demand.car_share(sites, "cars", "all").select(*[F.round(c, 9).alias(c) for c in ("share", "least", "greatest")])


CAR_SQL = "WITH s AS (SELECT sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::DOUBLE / nullif(sum(l_quantity), 0) AS r FROM lineitem GROUP BY l_suppkey) SELECT round(median(r), 9) AS share, round(min(r), 9) AS least, round(max(r), 9) AS greatest FROM s"


def delay_cost(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "orders").select("o_orderkey", queue.delay_cost(F.col("o_totalprice").cast("double") / 1000, 32.5).alias("cost"))


QUERIES = {
    "block_sections": (block_sections, f"WITH RECURSIVE {SECTIONS}"),
    "edges_beside": (edges_beside, BESIDE_SQL),
    "closed_edges": (closed_edges, CLOSED_SQL),
    "section_users": (section_users, f"WITH {SECTION_USERS} SELECT \"case\", section, n FROM su"),
    "gaining_sections": (gaining_sections, GAINING_SQL),
    "diverted_cars": (diverted_cars, DIVERTED_SQL),
    "extra_distance": (extra_distance, EXTRA_SQL),
    "leg_report": (leg_report, LEG_SQL),
    "car_share": (car_share, CAR_SQL),
    "delay_cost": (delay_cost, "SELECT o_orderkey, round_even(CAST(o_totalprice AS DOUBLE) / 1000 * 32.5::DOUBLE, 0) AS cost FROM orders"),
}
