"""Directed street graphs as edge tables: reachability, components, blocks, shortest paths.

The iterative operators join only a frontier in each round, rewrite what they have seen, and cut their lineage by a
table in the folder the session names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recovery import cut as _cut


def reachable(edges: DataFrame, seeds: DataFrame, forward: bool = True, most: int = 1000) -> DataFrame:
    """node and steps of all nodes that edges (src, dst) reach from seeds (node), the seeds included.

    With a column seed, seeds are kept apart: the result has each seed's own nodes.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    keys = ["seed", "node"] if "seed" in seeds.columns else ["node"]
    hops = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("_to")).distinct()
    hops = _cut(hops.where("node <> _to"))
    seen = _cut(seeds.select(*keys).distinct().withColumn("steps", F.lit(0)))
    for step in range(1, most + 1):
        new = seen.where(F.col("steps") == step - 1).join(hops, "node").select(*keys[:-1], F.col("_to").alias("node")).distinct().join(seen, keys, "left_anti")
        seen = _cut(seen.unionByName(new.withColumn("steps", F.lit(step))))
        if seen.where(F.col("steps") == step).isEmpty():
            return seen
    raise RuntimeError("reachable() did not end")


def strong_set(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that the seeds reach and that reach the seeds."""
    return reachable(edges, seeds).select("node").join(reachable(edges, seeds, forward=False).select("node"), "node")


def cut_off(edges: DataFrame, closed: Column, seeds: DataFrame) -> DataFrame:
    """Nodes reachable from the seeds on all edges and no longer without the closed ones."""
    return reachable(edges, seeds).select("node").join(reachable(edges.where(~closed), seeds).select("node"), "node", "left_anti")


def dead_ends(edges: DataFrame) -> DataFrame:
    """Nodes with a way in and none out."""
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def blocks(edges: DataFrame, most: int = 100) -> DataFrame:
    """node and block (its smallest node) of the undirected components of edges (src, dst), by least label with pointer jumps."""
    both = _cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src")).distinct())
    label = _cut(both.select(F.col("u").alias("node")).distinct().withColumn("block", F.col("node")))
    for _ in range(most):
        near = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("block").alias("near"))
        least = label.join(near, label["node"] == near["u"]).select("node", F.least("block", "near").alias("block"))
        jump = least.select(F.col("node").alias("block"), F.col("block").alias("up"))
        new = _cut(least.join(jump, "block").select("node", "up").withColumnRenamed("up", "block"))
        if new.exceptAll(label).isEmpty():
            return new
        label = new
    raise RuntimeError("blocks() did not settle")


def distances(edges: DataFrame, seeds: DataFrame, most: int = 1000) -> DataFrame:
    """node and least summed length from the seeds over edges (src, dst, length), by rounds of relaxation of what improved."""
    best = _cut(seeds.select("node").distinct().withColumn("distance", F.lit(0.0)))
    active = best
    for _ in range(most):
        tried = active.join(edges, active["node"] == edges["src"]).groupBy("dst").agg(F.min(F.col("distance") + F.col("length")).alias("d"))
        better = tried.join(best, tried["dst"] == best["node"], "left").where("distance is null or d < distance").select(F.col("dst").alias("node"), F.col("d").alias("distance"))
        active = _cut(better)
        if active.isEmpty():
            return best
        best = _cut(best.join(active.select("node"), "node", "left_anti").unionByName(active))
    raise RuntimeError("distances() did not settle")


def extra_distance(edges: DataFrame, closed: Column, seeds: DataFrame) -> DataFrame:
    """Per node the shortest distance with all edges and without the closed ones (null where none is left)."""
    full = distances(edges, seeds).withColumnRenamed("distance", "open_m")
    return full.join(distances(edges.where(~closed), seeds).withColumnRenamed("distance", "closed_m"), "node", "left")


def best_hub(edges: DataFrame, n: int = 12) -> DataFrame:
    """Of the n longest edges' starts (a report's top k) the one from which most nodes can be reached."""
    longest = edges.orderBy(F.desc("length"), "src", "dst").limit(n).select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    sizes = reachable(edges, longest).groupBy("seed").agg(F.count("*").alias("reached"))
    return sizes.orderBy(F.desc("reached"), "seed").limit(1).select(F.col("seed").alias("node"), "reached")


def signed_detours(routes: DataFrame, detours: DataFrame, spare: float = 100.0) -> DataFrame:
    """Routes cut at the closure and rejoined after the signed detour.

    routes: id, at (position of the closed edge), positions after it with their edge (rest: array of struct(pos, edge)).
    detours: edge, length (from the closure to that edge by the signs). The rejoining edge is the earliest that is not
    over `spare` longer than the best.
    """
    met = routes.select("id", F.inline("rest")).join(detours, "edge")
    best = met.groupBy("id").agg(F.min("length").alias("best"))
    fit = met.join(best, "id").where(F.col("length") <= F.col("best") + spare)
    return fit.groupBy("id").agg(F.min_by(F.struct("pos", "edge", "length"), F.struct("pos", "length")).alias("r")).select("id", "r.*")


def allowed(tags: Column) -> Column:
    """Whether a way's access tag lets general traffic through."""
    return ~F.coalesce(F.try_element_at(tags, F.lit("access")).isin("permit", "no", "private", "delivery", "customers"), F.lit(False))


def prune_routes(routes: DataFrame, closed: list[str]) -> DataFrame:
    """Routes (edges) without those that begin or end on a closed edge, with a flag for those that pass one."""
    own = F.array(*[F.lit(c) for c in closed])
    ends = F.array_contains(own, F.element_at("edges", 1)) | F.array_contains(own, F.element_at("edges", -1))
    return routes.where(~ends).withColumn("passes", F.arrays_overlap("edges", own))


def cut_off_ends(edges: DataFrame, closed: DataFrame, seeds: DataFrame) -> DataFrame:
    """node and whether a closure (node) makes it unreachable (no_way_in) or a trap (no_way_out), of the open nodes that were joined to the seeds both ways."""
    shut = closed.select("node").distinct()
    open_ = edges
    for end in ("src", "dst"):
        open_ = open_.join(shut.withColumnRenamed("node", end), end, "left_anti")
    base = strong_set(edges, seeds).select("node").distinct().join(shut, "node", "left_anti")
    reached, left = (reachable(open_, seeds, way).select("node", F.lit(True).alias(name)) for way, name in ((True, "_in"), (False, "_out")))
    met = base.join(reached, "node", "left").join(left, "node", "left")
    out = met.select("node", F.col("_in").isNull().alias("no_way_in"), F.col("_out").isNull().alias("no_way_out"))
    return _cut(out.where("no_way_in or no_way_out"))


def removals(trips: DataFrame, closed: DataFrame, cut_off: DataFrame, through_only: bool = False) -> DataFrame:
    """Trips (id, first, last) with the reason why the closure removes them, the first that holds; null for those that stay.

    closed: node; cut_off: as of cut_off_ends. through_only: the closed block has no driveways, so trips that start where no way leads out are
    removed too, as they would be left out of the pool of routes.
    """
    shut = closed.select("node").distinct()
    met = trips
    for end in ("first", "last"):
        met = met.join(shut.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}_closed")), end, "left")
        met = met.join(cut_off.select(F.col("node").alias(end), F.col("no_way_in").alias(f"_{end}_in"), F.col("no_way_out").alias(f"_{end}_out")), end, "left")
    reason = F.when(F.col("_first_closed"), "starts on a closed edge").when(F.col("_last_closed"), "ends on a closed edge").when(F.col("_last_in"), "ends where no way leads")
    if through_only:
        reason = reason.when(F.col("_first_out") | F.col("_first_in") | F.col("_last_out"), "starts or ends beside the closure")
    return met.select(*trips.columns, reason.alias("reason"))


def demands(trips: DataFrame, closed: list, rerouted: DataFrame, signed: DataFrame) -> DataFrame:
    """The same trips for each case: case (base, closure, signed) and the trips' columns, with the edges driven in that case.

    trips: id, edges and more; rerouted and signed: id, edges, a row for each trip with such a way. A trip over a closed
    edge that cannot be rerouted is left out of every case; one without a signed way (trapped) takes the other. With none
    of both tables' rows all cases are equal.
    """
    uses = F.arrays_overlap("edges", F.array(*[F.lit(c) for c in closed]))
    met = trips.withColumn("_uses", F.coalesce(uses, F.lit(False))).join(rerouted.select("id", F.col("edges").alias("_r")), "id", "left").join(signed.select("id", F.col("edges").alias("_s")), "id", "left")
    kept = met.where(~F.col("_uses") | F.col("_r").isNotNull())
    way = lambda name, edges: F.struct(F.lit(name).alias("case"), edges.alias("edges"))
    own = F.col("edges")
    ways = F.array(way("base", own), way("closure", F.when(F.col("_uses"), F.col("_r")).otherwise(own)), way("signed", F.when(F.col("_uses"), F.coalesce("_s", "_r")).otherwise(own)))
    rest = [c for c in trips.columns if c != "edges"]
    return kept.select(*rest, F.inline(ways))


def replicate(vehicles: DataFrame, times: int, jitter: float = 150.0, seed: int = 1) -> DataFrame:
    """Each vehicle (id, depart) with times - 1 copies, departing up to `jitter` seconds earlier or later, the same on every run."""
    n = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    u = F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.lit(1_000_001)) / 1_000_000.0
    return vehicles.withColumn("copy", n).withColumn("depart", F.when(F.col("copy") == 0, F.col("depart")).otherwise(F.greatest(F.lit(0.0), F.col("depart") + (2 * u - 1) * jitter)))
