"""Operators where very many rows meet: results as before, without the rows of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import demand, grid, nearest


def _made_rows(df) -> int:
    """Rows that the joins of a plan give, as executed."""
    df.collect()
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while stack:
        node = stack.pop()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if "Join" in node.nodeName():
            n += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_turn_rules_are_counted_as_their_rows_would_be(spark):
    edges = spark.createDataFrame([(1, "a", "N", 1), (1, "a", "N", 2), (1, "a", "N", 2), (1, "a", "N", None), (1, "b", "E", 3), (1, "b", "S", 4), (2, "a", "N", 1), (None, "a", "N", 9)], "site int, name string, side string, edge int")
    rules = spark.createDataFrame([(k, site, f, "N", t, kind) for k, (site, f, t, kind) in enumerate((s, f, t, kind) for s in (1, 2, 3, None) for f in "abc" for t in "abc" for kind in ("ban", "hook_turn", None))], "rule int, site int, from_name string, from_side string, to_name string, kind string")
    restrictions = spark.createDataFrame([(1, 3), (2, 4), (2, 4), (2, 2), (3, 1), (None, 3)], "from_edge int, to_edge int")
    want = {r["status"]: r["n"] for r in demand.turn_status(rules, restrictions, edges).groupBy("status").agg(F.count("*").alias("n")).collect()}
    got = {r["status"]: r["n"] for r in demand.turn_counts(rules, restrictions, edges).collect()}
    assert got == want
    assert set(want) == {"unresolved", "confirmed", "added", "noted"}


def test_turn_rules_with_many_edges_of_a_name(spark, tmp_path):
    from sluice.plans import details

    spark.range(400).select((F.col("id") * 20).alias("p_partkey"), F.lit("b").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(50).select(F.col("id").alias("l_suppkey"), (F.col("id") * 20).alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = details.turn_rules(spark, str(tmp_path))
    assert _made_rows(out) < 10_000
    assert sum(r["n"] for r in out.collect()) == 50 * 400 * 400


def test_rules_at_junctions_are_not_broadcast(spark, sf):
    from sluice.plans import junctions

    out = junctions.hook_turns(spark, sf)
    assert out.count() > 0
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_junctions_are_found_once_a_place(spark):
    edges = spark.createDataFrame([("e1", "H", 1, 2, 0.0, 0.0, 100.0, 0.0), ("e2", "V", 2, 3, 100.0, 0.0, 100.0, -100.0), ("e3", "V", 2, 4, 100.0, 0.0, 100.0, 100.0)], "edge string, name string, src int, dst int, x0 double, y0 double, x1 double, y1 double")
    sites = spark.range(500).select(F.col("id").alias("site"), F.when(F.col("id") < 490, 110.0).alias("x"), F.lit(5.0).alias("y"))
    rules = sites.select(F.col("site").alias("rule"), F.when(F.col("site") % 2 == 0, "hook").otherwise("ban").alias("kind"), "site", F.lit("H").alias("from_name"), F.lit("E").alias("from_direction"), F.lit("V").alias("to_name"), F.lit("S").alias("to_direction"))
    out = demand.resolved_turns(rules, sites, edges, spark.createDataFrame([("e1", "e2")], "from_edge string, to_edge string"))
    got = {(r["status"], r["junction"], r["to_edge"]): r["n"] for r in out.groupBy("status", "junction", "to_edge").agg(F.count("*").alias("n")).collect()}
    assert got == {("applied", 2, "e2"): 245, ("NOT APPLIED", 2, "e2"): 245, ("no junction", None, None): 10}


def test_places_and_courses_are_met_once(spark):
    from sluice.operators import exposure

    points = spark.range(3000).select("id", (F.col("id") % 3 * 10.0).alias("x"), F.lit(1.0).alias("y"))
    segments = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 2 * 1.0).alias("ax"), F.lit(0.0).alias("ay"), F.when(F.col("id") % 2 == 1, 20.0).otherwise(0.0).alias("bx"), F.lit(0.0).alias("by"))
    out = exposure.nearest_segment(points, segments, "key", 60.0)
    assert _made_rows(out) < 10_000
    rows = out.collect()
    assert len(rows) == 3000
    assert {(r["id"] % 3, r["key"], round(r["dist_m"], 9)) for r in rows} == {(0, 0, 1.0), (1, 1, 1.0), (2, 1, 1.0)}


def test_volumes_of_nearest_segments_meet_places_once(spark, tmp_path):
    from sluice.plans import details

    spark.range(300).select((F.col("id") * 61 * 47).alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(200).select((F.col("id") * 31 * 23 * 15).alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(200).select((F.col("id") * 31 * 23 * 15).alias("l_suppkey"), F.col("id").cast("double").alias("l_quantity"), F.lit(0.1).alias("l_tax"), F.lit("F").alias("l_linestatus")).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = details.nearest_aadt(spark, str(tmp_path))
    assert _made_rows(out) < 5_000
    assert {(r["segment_id"], r["aadt"], r["aadt_directions"]) for r in out.collect()} == {(0, 0.0, "F")} and out.count() == 300


def test_window_with_points_on_its_border(spark):
    from sluice.operators import scene

    p = [(0, k, x, y) for k, (x, y) in enumerate([(1.5, -1.5), (3.0, 0.0), (-1.0, 0.0), (1.4, 1.5), (1.5, 0.0), (-0.9, 1.4), (-3.7, -1.5), (1.4999, -1.4999)])]
    points = spark.createDataFrame(p, "scan int, pid int, x double, y double")
    right = [(0.5, -0.5), (-1.0, 2.0), (-1.5, 1.0)]
    for direction, turn in ((90.0, lambda x, y: (y, x)), (270.0, lambda x, y: (-y, -x)), (-90.0, lambda x, y: (-y, -x)), (0.0, lambda x, y: (x, -y)), (180.0, lambda x, y: (-x, y)), (450.0, lambda x, y: (y, x))):
        got = {r["pid"] for r in scene.windowed(points, right[0], direction, right[1], right[2]).collect()}
        want = set()
        for _, k, x, y in p:
            along, across = turn(x - 0.5, y + 0.5)
            want |= {k} if -1.0 < along < 2.0 and -1.5 < across < 1.0 else set()
        assert got == want, direction


@pytest.mark.parametrize("name", ["vertical_agreement", "fit_quality", "plane_distances", "wall_fit", "nearest_neighbour_radius"])
def test_dense_clouds_make_no_row_for_each_pair(spark, tmp_path, monkeypatch, name):
    from sluice.functions import stats
    from sluice.plans import registry

    placed, made = stats.placed, []
    monkeypatch.setattr(stats, "placed", lambda rows, *more: made.append(_made_rows(rows)) or placed(rows, *more))
    v = [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 10000).cast("float") for k in range(3)]
    spark.range(1200).select(F.col("id").alias("vec_id"), F.array(*v).alias("embedding"), (F.col("id") % 2).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = registry.queries()[name](spark, str(tmp_path))
    assert max([_made_rows(out), *made]) < 30 * 1200
    assert out.count() > 0


def _cloud(n: int, seed: int) -> np.ndarray:
    """A dense ball, a lattice with many equal distances, copies, a few far away."""
    rng = np.random.default_rng(seed)
    lattice = np.stack(np.meshgrid(*[np.arange(5) * 0.5] * 3), -1).reshape(-1, 3)
    own = np.concatenate([rng.normal(0, 0.05, (n, 3)), lattice, rng.uniform(-3, 3, (n // 4, 3))])
    return np.concatenate([own, own[::7], own[:1].repeat(40, 0)]).round(3)


@pytest.mark.parametrize(("k", "root"), [(1, False), (4, True)])
def test_nearest_as_by_brute_force(spark, monkeypatch, k, root):
    monkeypatch.setattr(nearest, "BOX", 25)
    monkeypatch.setattr(nearest, "VISITORS", 1)
    a, b, radius = _cloud(160, 1), _cloud(200, 2), 1.5
    rows = lambda p, name: [(str(i % 2), int(i * 7919 % len(p)), *map(float, x)) for i, x in enumerate(p)] + [("0", -1, None, 0.0, 0.0), ("0", -2, float("nan"), 0.0, 0.0), ("9" if name == "pid" else "8", -3, 0.0, 0.0, 0.0), (None, -4, 0.0, 0.0, 0.0)]
    m, f = (spark.createDataFrame(rows(p, c), f"pair string, {c} long, x double, y double, z double") for p, c in ((a, "pid"), (b, "fid")))
    found, kept = nearest.nearest(m, f, radius, k, root)
    at = {r["row"]: r["fid"] for r in kept.collect()}
    got = {}
    for r in found.collect():
        assert all(at[x["row"]] == x["fid"] for x in r["near"])
        got[r["pair"], r["x"], r["y"], r["z"]] = [(x["d"], x["fid"]) for x in r["near"]]
    want = {}
    for pair in "01":
        fixed = [(r[1], np.array(r[2:])) for r in rows(b, "fid") if r[0] == pair and r[1] >= 0]
        for r in rows(a, "pid"):
            if r[0] == pair and r[1] >= 0:
                x, y, z = np.stack([p for _, p in fixed]).T
                d = (r[2] - x) ** 2 + (r[3] - y) ** 2 + (r[4] - z) ** 2
                near = sorted((float(np.sqrt(v)) if root else float(v), fid) for v, (fid, _) in zip(d, fixed, strict=True) if (np.sqrt(v) <= radius if root else v <= radius * radius))
                if near:
                    want[pair, *r[2:]] = near[:k]
    assert len(want) > 300
    assert got == want


def test_neighbours_leave_themselves_out_among_copies(spark):
    p = spark.range(30).select(F.lit(1).alias("scan"), F.col("id").alias("pid"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.when(F.col("id") == 29, 0.5).otherwise(0.0).alias("z"))
    got = {(r["pid"], r["rank"]): (r["other"], r["distance"]) for r in grid.neighbours(p, p, 0.8, 2).collect()}
    want = {(k, n + 1): (o, 0.5 if k == 29 else 0.0) for k in range(30) for n, o in enumerate([x for x in range(30) if x != k][:2])}
    assert got == want


def test_positions_are_met_once(spark):
    points = spark.range(2000).select("id", (F.col("id") % 2 * 0.001 - 37.8).alias("lat"), F.lit(144.9).alias("lon"))
    places = spark.range(1500).select(F.col("id").alias("key"), (F.col("id") % 3 * 0.001 - 37.8).alias("lat"), F.lit(144.9).alias("lon"))
    out = demand.nearest_of(points, places, "id", "key", 400.0, 2)
    assert _made_rows(out) < 10_000
    rows = out.collect()
    assert len(rows) == 4000
    assert {(r["id"] % 2, r["key"], r["rank"], round(r["distance_m"], 6)) for r in rows} == {(0, 0, 1, 0.0), (0, 3, 2, 0.0), (1, 1, 1, 0.0), (1, 4, 2, 0.0)}


def test_nearest_without_a_common_pair(spark):
    m, f = (spark.createDataFrame([(pair, 1, 0.0, 0.0, 0.0)], f"pair int, {c} long, x double, y double, z double") for pair, c in ((1, "pid"), (2, "fid")))
    found, rows = nearest.nearest(m, f, 1.0)
    assert found.count() == 0 and rows.count() == 0
