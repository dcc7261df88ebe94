"""Queries of what a closure does to trips, and of turn rules at junctions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import demand, graph
from . import simulations
from . import tables as t


def _shut(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a remainder of nations, but the seed, stand for the closed edges."""
    return t.table(spark, d, "supplier").where("s_nationkey % 3 = 1 and s_suppkey <> 20").select(F.col("s_suppkey").alias("node"))


def removal_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Line items as trips from a supplier's edge to the one of the part: how many a closure removes, by reason. The seed is an open edge that much of the graph leads to and from."""
    edges, closed = simulations._edges(spark, d), _shut(spark, d)
    seed = spark.range(20, 21).select(F.col("id").alias("node"))
    off = graph.cut_off_ends(edges, closed, seed)
    n = t.table(spark, d, "supplier").agg(F.max("s_suppkey").alias("n"))
    trips = t.table(spark, d, "lineitem").crossJoin(F.broadcast(n)).select(F.col("l_suppkey").alias("first"), (F.col("l_partkey") % F.col("n") + 1).alias("last"))
    return graph.removals(trips, closed, off, through_only=True).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("trips"))


REMOVAL_SQL = f"""WITH RECURSIVE {simulations.EDGES},
shut AS (SELECT s_suppkey AS node FROM supplier WHERE s_nationkey % 3 = 1 AND s_suppkey <> 20), op AS (SELECT * FROM ed WHERE src NOT IN (SELECT node FROM shut) AND dst NOT IN (SELECT node FROM shut)),
seed AS (SELECT CAST(20 AS BIGINT) AS node),
af AS (SELECT node FROM seed UNION SELECT dst FROM af JOIN ed ON src = node), ab AS (SELECT node FROM seed UNION SELECT src FROM ab JOIN ed ON dst = node),
cf AS (SELECT node FROM seed UNION SELECT dst FROM cf JOIN op ON src = node), cb AS (SELECT node FROM seed UNION SELECT src FROM cb JOIN op ON dst = node),
base AS (SELECT node FROM af INTERSECT SELECT node FROM ab EXCEPT SELECT node FROM shut), noin AS (SELECT node FROM base EXCEPT SELECT node FROM cf), noout AS (SELECT node FROM base EXCEPT SELECT node FROM cb),
tr AS (SELECT l_suppkey AS a, l_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS b FROM lineitem)
SELECT CASE WHEN a IN (SELECT node FROM shut) THEN 'starts on a closed edge' WHEN b IN (SELECT node FROM shut) THEN 'ends on a closed edge' WHEN b IN (SELECT node FROM noin) THEN 'ends where no way leads'
WHEN a IN (SELECT node FROM noout) OR a IN (SELECT node FROM noin) OR b IN (SELECT node FROM noout) THEN 'starts or ends beside the closure' ELSE 'kept' END AS reason, count(*) AS trips FROM tr GROUP BY 1"""


def hook_turns(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as junctions of a street grid of ten columns, customers as sites near them with rules on the streets there, by status."""
    k = F.col("s_suppkey") - 1
    nodes = t.table(spark, d, "supplier").select(k.alias("node"), (k % 10 * 100 + F.when(k % 3 == 0, 30).otherwise(0)).cast("double").alias("x"), (F.floor(k / 10) * 100).cast("double").alias("y"))
    far = nodes.select(F.col("node").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    east = F.struct((F.col("node") + 1).alias("dst"), F.concat(F.lit("H"), F.floor(F.col("node") / 10)).alias("name"))
    north = F.struct((F.col("node") + 10).alias("dst"), F.concat(F.lit("V"), F.col("node") % 10).alias("name"))
    ahead = nodes.select(F.col("node").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.inline(F.filter(F.array(east, north), lambda w: (w["dst"] % 10 != 0) | (w["dst"] - F.col("node") == 10)))).join(far.hint("merge"), "dst")
    back = ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "name", F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    edges = ahead.select(*back.columns).unionByName(back).withColumn("edge", F.concat_ws("-", "src", "dst"))
    links = edges.select(F.col("edge").alias("from_edge"), F.col("dst").alias("m"), "src").join(edges.select(F.col("src").alias("m"), F.col("edge").alias("to_edge"), F.col("dst").alias("b")).hint("merge"), "m").where((F.col("src") != F.col("b")) & (F.pmod(F.col("src") + F.col("b"), F.lit(5)) != 0)).select("from_edge", "to_edge")
    c = F.col("c_custkey")
    own = t.table(spark, d, "customer").select(c.alias("rule"), F.when(c % 2 == 0, "ban").otherwise("hook").alias("kind"), c.alias("site"), F.concat(F.lit("H"), F.floor(c / 10) % 4).alias("from_name"), F.when(c % 3 == 0, "W").otherwise("E").alias("from_direction"), F.concat(F.lit("V"), c % 10).alias("to_name"), F.when(c % 5 < 2, "N").otherwise("S").alias("to_direction"))
    sites = t.table(spark, d, "customer").select(c.alias("site"), (c % 10 * 100 + c % 13 * 6).cast("double").alias("x"), (F.floor(c / 10) % 4 * 100 + c % 7 * 5).cast("double").alias("y"))
    out = demand.resolved_turns(own, sites, edges, links)
    return out.groupBy("status", "turn").agg(F.count("*").alias("n"), F.count_distinct("rule").alias("rules"), F.round(F.sum("distance"), 6).alias("distance"))


HOOK_SQL = """WITH n AS (SELECT s_suppkey - 1 AS node, CAST((s_suppkey - 1) % 10 * 100 + CASE WHEN (s_suppkey - 1) % 3 = 0 THEN 30 ELSE 0 END AS DOUBLE) AS x, CAST((s_suppkey - 1) // 10 * 100 AS DOUBLE) AS y FROM supplier),
w AS (SELECT a.node AS src, b.node AS dst, CASE WHEN b.node - a.node = 10 THEN 'V' || (a.node % 10) ELSE 'H' || (a.node // 10) END AS name, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM n a JOIN n b ON b.node = a.node + 10 OR (b.node = a.node + 1 AND b.node % 10 <> 0)),
ed AS (SELECT *, src || '-' || dst AS edge FROM (SELECT * FROM w UNION ALL SELECT dst, src, name, x1, y1, x0, y0 FROM w)),
e AS (SELECT *, degrees(atan2(x1 - x0, y1 - y0)) AS bearing, ['N', 'E', 'S', 'W'][CAST(floor(((degrees(atan2(x1 - x0, y1 - y0)) + 45) - 360 * floor((degrees(atan2(x1 - x0, y1 - y0)) + 45) / 360)) / 90) + 1 AS INTEGER)] AS dir FROM ed),
l AS (SELECT DISTINCT a.edge AS f, b.edge AS g FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst AND (a.src + b.dst) % 5 <> 0),
c AS (SELECT c_custkey AS rule, CASE WHEN c_custkey % 2 = 0 THEN 'ban' ELSE 'hook' END AS kind, 'H' || (c_custkey // 10 % 4) AS fn, CASE WHEN c_custkey % 3 = 0 THEN 'W' ELSE 'E' END AS fd, 'V' || (c_custkey % 10) AS tn, CASE WHEN c_custkey % 5 < 2 THEN 'N' ELSE 'S' END AS td,
CAST(c_custkey % 10 * 100 + c_custkey % 13 * 6 AS DOUBLE) AS x, CAST(c_custkey // 10 % 4 * 100 + c_custkey % 7 * 5 AS DOUBLE) AS y FROM customer),
j AS (SELECT c.rule, n.node, sqrt(pow(c.x - n.x, 2) + pow(c.y - n.y, 2)) AS distance FROM c, n WHERE n.node IN (SELECT src FROM e) AND sqrt(pow(c.x - n.x, 2) + pow(c.y - n.y, 2)) <= 200 QUALIFY row_number() OVER (PARTITION BY c.rule ORDER BY distance, n.node) = 1),
r AS (SELECT c.*, j.node AS junction, j.distance FROM c LEFT JOIN j ON j.rule = c.rule),
f AS (SELECT r.rule, count(*) AS nf, any_value(e.edge) AS edge, any_value(e.bearing) AS bearing FROM r JOIN e ON e.dst = r.junction AND e.name = r.fn AND e.dir = r.fd GROUP BY 1),
g AS (SELECT r.rule, e.edge, e.bearing FROM r JOIN e ON e.src = r.junction WHERE r.kind = 'hook' OR (e.name = r.tn AND e.dir = r.td)), ng AS (SELECT rule, count(*) AS n FROM g GROUP BY 1),
y AS (SELECT r.rule, r.kind, r.junction, r.distance, f.edge AS fe, f.bearing AS fb, CASE WHEN r.junction IS NULL THEN 'no junction' WHEN r.distance > 60 THEN 'junction too far' WHEN coalesce(f.nf, 0) <> 1 OR (r.kind = 'ban' AND coalesce(ng.n, 0) <> 1) THEN 'unresolved approach' END AS why FROM r LEFT JOIN f ON f.rule = r.rule LEFT JOIN ng ON ng.rule = r.rule),
tr AS (SELECT y.*, g.edge AS te, (g.bearing - y.fb + 180) - 360 * floor((g.bearing - y.fb + 180) / 360) - 180 AS turned FROM y JOIN g ON g.rule = y.rule WHERE why IS NULL),
k AS (SELECT *, CASE WHEN abs(turned) > 150 THEN 't' WHEN turned > 45 THEN 'r' WHEN turned > 22.5 THEN 'R' WHEN turned < -45 THEN 'l' WHEN turned < -22.5 THEN 'L' ELSE 's' END AS turn FROM tr),
v AS (SELECT rule, kind, distance, turn, CASE WHEN ((fe, te) IN (SELECT (f, g) FROM l)) = (kind = 'hook') THEN 'applied' ELSE 'NOT APPLIED' END AS status FROM k WHERE kind = 'ban' OR turn IN ('r', 'R')),
z AS (SELECT * FROM v UNION ALL SELECT rule, kind, distance, NULL, coalesce(why, 'no right turn') FROM y WHERE rule NOT IN (SELECT rule FROM v))
SELECT status, turn, count(*) AS n, count(DISTINCT rule) AS rules, round(sum(distance), 6) AS distance FROM z GROUP BY 1, 2"""


QUERIES = {"removal_accounting": (removal_accounting, REMOVAL_SQL), "hook_turns": (hook_turns, HOOK_SQL)}
