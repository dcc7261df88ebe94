"""Streets as named edges (edge, src, dst, name, way): closed edges, block sections, and who drives on them.

An unnamed edge has the name "" (a roundabout's ring, a slip road); a missing name counts as "". way is the direction of
travel. Edges are those that cars may use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.recovery import cut

OUTSIDE = "the edge of the study area"


def edges_along(edges: DataFrame, lines: DataFrame, most_offset: float = 25.0) -> DataFrame:
    """line, edge and place (from 1) of the edges of a line's street and way whose middle (mx, my) lies beside it.

    lines: line, name, way, x1, y1, x2, y2. Beside: the foot of the perpendicular is on the line, at most most_offset away.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    px, py = F.col("mx") - F.col("x1"), F.col("my") - F.col("y1")
    along, off = (px * dx + py * dy) / (dx * dx + dy * dy), F.abs(px * dy - py * dx) / F.sqrt(dx * dx + dy * dy)
    met = edges.join(lines, ["name", "way"]).where((dx != 0) | (dy != 0)).withColumns({"along": along, "off": off})
    near = met.where(F.col("along").between(0, 1) & (F.col("off") <= most_offset))
    return near.select("line", "edge", F.row_number().over(Window.partitionBy("line").orderBy("along", "edge")).alias("place"))


def closed_between(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """site and edge: edges of a site's street, either way, from its junction to a node that the cross street touches.

    sites: site, node, street, cross.
    """
    ends = edges.select("edge", "name", F.col("src").alias("node"), F.col("dst").alias("far")).unionByName(edges.select("edge", "name", F.col("dst").alias("node"), F.col("src").alias("far")))
    touched = edges.select(F.col("src").alias("far"), F.col("name").alias("cross")).union(edges.select("dst", "name")).distinct()
    own = ends.withColumnRenamed("name", "street").join(sites, ["node", "street"])
    return own.join(touched, ["far", "cross"]).select("site", "edge").distinct()


def _most_named(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Of each key the name with the largest n; the lesser name among equals."""
    return rows.groupBy(*keys).agg(F.min(F.struct((-F.col(n)).alias("n"), F.col("name"))).alias("_m")).select(*keys, F.col("_m.name").alias("end"))


def _through(stuck: DataFrame, names: DataFrame, links: DataFrame, rings: int) -> DataFrame:
    """node, street and end: the other street met through unnamed links, the nearest ring that has one, else OUTSIDE."""
    seen = cut(stuck.select("node", "street", F.col("node").alias("at"), F.lit(0).alias("ring")).distinct())
    for ring in range(1, rings):
        new = seen.where(F.col("ring") == ring - 1).join(links, seen["at"] == links["u"]).select("node", "street", F.col("v").alias("at")).distinct()
        new = new.join(seen, ["node", "street", "at"], "left_anti").withColumn("ring", F.lit(ring))
        if ring > 1:  # a street already met ends the search of its node
            new = new.join(_met(seen, names).select("node", "street").distinct(), ["node", "street"], "left_anti")
        seen = cut(seen.unionByName(new.select(*seen.columns)))
    met = _met(seen, names)
    first = met.groupBy("node", "street").agg(F.min("ring").alias("ring"))
    counted = met.join(first, ["node", "street", "ring"]).groupBy("node", "street", "name").agg(F.sum("n").alias("n"))
    return _most_named(counted, ["node", "street"], "n")


def _met(seen: DataFrame, names: DataFrame) -> DataFrame:
    return seen.join(names.withColumnRenamed("node", "at"), "at").where("name <> street")


def block_sections(edges: DataFrame, steps: int = 15, rings: int = 4) -> DataFrame:
    """edge, name, way, behind and ahead: the cross streets between which a named edge lies.

    From each end the walk goes on along edges of the same street and way (the least of several), until another street
    touches the node; the one with most edges there counts, the lesser name among equals. Where the street ends, unnamed
    links are looked through, up to `rings` junctions wide. Without any the end is OUTSIDE. Edges with the same street at
    both ends lie inside a junction and go.
    """
    e = cut(edges.select("edge", "src", "dst", F.coalesce("name", F.lit("")).alias("name"), "way"))
    names = cut(e.where("name <> ''").select("name", F.explode(F.array("src", "dst")).alias("node")).groupBy("node", "name").agg(F.count("*").alias("n")))
    bare = e.where("name = ''")
    links = cut(bare.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(bare.select("dst", "src")).where("u <> v").distinct())
    rank = Window.partitionBy("node").orderBy(F.desc("n"), "name")
    two = names.withColumn("r", F.row_number().over(rank)).where("r <= 2")  # the other street at a node is one of its two foremost
    heads = cut(two.groupBy("node").agg(F.max(F.when(F.col("r") == 1, F.col("name"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("name"))).alias("two")))
    named = e.where("name <> ''")
    ends = named.select("edge", "name", "way", F.lit("ahead").alias("side"), F.col("src").alias("near"), F.col("dst").alias("far")).union(named.select("edge", "name", "way", F.lit("behind"), "dst", "src"))
    onward = cut(ends.groupBy("name", "way", "side", F.col("near").alias("node")).agg(F.min(F.struct("edge", "far")).alias("_next")))
    walk = cut(ends.select("edge", F.col("name").alias("street"), "way", "side", F.col("far").alias("node")))
    done = None
    for step in range(1, steps + 1):
        at = walk.join(heads, "node", "left").withColumn("end", F.when(F.col("one") != F.col("street"), F.col("one")).otherwise(F.col("two")))
        at = cut(at.join(onward.withColumnRenamed("name", "street"), ["node", "street", "way", "side"], "left"))
        ended = at.where("end is not null or _next is null").select("edge", "side", "street", "node", "end")
        done = ended if done is None else done.unionByName(ended)
        walk = at.where("end is null and _next is not null").select("edge", "street", "way", "side", F.col("_next.far").alias("node"))
        if walk.isEmpty():
            break
    done = cut(done)
    stuck = done.where("end is null").drop("end")
    looked = stuck.join(_through(stuck, names, links, rings), ["node", "street"], "left")
    found = done.where("end is not null").unionByName(looked.select(*done.columns))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("end")))
    both = found.groupBy("edge").agg(side("behind").alias("behind"), side("ahead").alias("ahead"))
    out = named.select("edge", "name", "way").join(both, "edge", "left").withColumns({c: F.coalesce(c, F.lit(OUTSIDE)) for c in ("behind", "ahead")})
    return out.where("behind <> ahead")


def section_users(routes: DataFrame, sections: DataFrame, keys: list[str], vehicle: str, edges: str = "edges") -> DataFrame:
    """keys, section and n: vehicles that drive on a section, each once however often it does. sections: edge, section."""
    driven = routes.select(*keys, vehicle, F.explode(edges).alias("edge")).distinct()
    return driven.join(sections, "edge").select(*keys, vehicle, "section").distinct().groupBy(*keys, "section").agg(F.count("*").alias("n"))


def gains(users: DataFrame, n_seeds: int) -> DataFrame:
    """section and gain: vehicles a seed more in the closure case than in the base. users: case (base, closure), section, n."""
    sign = F.when(F.col("case") == "base", -F.col("n")).otherwise(F.col("n"))
    return users.groupBy("section").agg((F.sum(sign) / n_seeds).alias("gain"))


def load_verdict(share: Column) -> Column:
    return F.when(share < 0.6, "well within capacity").when(share < 0.85, "busy").otherwise("near or over capacity")


def gaining(users: DataFrame, flows: DataFrame, n_seeds: int, least: float, lane_capacity: float = 800.0, most: int = 8) -> DataFrame:
    """The `most` sections that gain the most vehicles (a top-k report), at least `least`, at the point where a lane is fullest.

    flows: section, edge, lanes, case, entered (one row a run). Flows are means over runs, the peak the greatest of the
    closure case; edges without a run count 0.
    """
    of = lambda c, f: f(F.when(F.col("case") == c, F.col("entered")))
    edges = flows.groupBy("section", "edge", "lanes").agg(F.coalesce(of("base", F.avg), F.lit(0.0)).alias("normal"), F.coalesce(of("closure", F.avg), F.lit(0.0)).alias("with_closure"), F.coalesce(of("closure", F.max), F.lit(0.0)).alias("peak"))
    edges = edges.withColumn("share", F.col("peak") / (F.col("lanes") * lane_capacity))
    fullest = edges.groupBy("section").agg(F.min(F.struct((-F.col("share")).alias("s"), F.col("edge"), F.col("lanes"), F.col("normal"), F.col("with_closure"), F.col("peak"), F.col("share"))).alias("f")).select("section", "f.edge", "f.lanes", "f.normal", "f.with_closure", "f.peak", "f.share")
    top = gains(users, n_seeds).where(F.col("gain") >= least).orderBy(F.desc("gain"), "section").limit(most)
    return top.join(fullest, "section").withColumn("verdict", load_verdict(F.col("share")))


def diverted(counts: DataFrame, closed: list[str]) -> DataFrame:
    """Cars that the closed block takes over the hours: of each hour and seed the most on one closed edge; least, median, greatest over seeds.

    counts: seed, hour, edge, entered.
    """
    hours = counts.where(F.col("edge").isin(*closed)).groupBy("seed", "hour").agg(F.max("entered").alias("n"))
    seeds = hours.groupBy("seed").agg(F.sum("n").alias("n"))
    return seeds.agg(F.bround(F.min("n")).alias("low"), F.bround(F.median("n")).alias("typical"), F.bround(F.max("n")).alias("high"))


def extra_distance(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of the extra metres (difference) of paired trips, by the index rule; none below 0."""
    at = lambda p: F.greatest(F.lit(0.0), F.bround(stats.index_quantile(p).cast("double")))
    return stats.placed(pairs, keys, F.col("difference")).groupBy(*keys).agg(at(0.25).alias("low"), at(0.5).alias("typical"), at(0.75).alias("high"), F.max("size").alias("n_trips"))


def leg_report(runs: DataFrame, noise: DataFrame) -> DataFrame:
    """Per leg: typical and worst queue and mean seconds of both cases, the typical difference of two normal runs, and whether the queue grows by more.

    runs: leg, case, queue_m, seconds (one row an hour and seed); noise: leg, seed, hour, queue_m of the normal runs, whose
    next seed in the same hour is compared.
    """
    of = lambda c, x: F.when(F.col("case") == c, F.col(x))
    out = runs.groupBy("leg").agg(*[a for c in ("base", "closure") for a in (F.median(of(c, "queue_m")).alias(f"{c}_typical"), F.max(of(c, "queue_m")).alias(f"{c}_worst"), F.avg(of(c, "seconds")).alias(f"{c}_seconds"))])
    apart = F.abs(F.col("queue_m") - F.lag("queue_m").over(Window.partitionBy("leg", "hour").orderBy("seed")))
    usual = noise.withColumn("apart", apart).groupBy("leg").agg(F.coalesce(F.median("apart"), F.lit(0.0)).alias("noise"))
    growth = F.col("closure_typical") - F.col("base_typical")
    return out.join(usual, "leg", "left").fillna({"noise": 0.0}).withColumn("grows", (growth > F.col("noise")) & (growth >= 5))
