"""Readers and writers on small files."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import exposure
from sluice.sources import clouds, feeds, xml


def test_notices(spark, tmp_path):
    props = {"id": 7, "state": "VIC", "updated_category": "Planned Roadworks", "street_name": "Swan Street", "description": "during the following times: Weekdays 8:00 PM to 5:30 AM. Impact to traffic will be lanes closed northbound. ", "from_date": 1710000000000, "to_date": 1710200000000}
    features = [{"geometry": {"type": "Point", "coordinates": [144.99, -37.82]}, "properties": props}, {"geometry": None, "properties": props}]
    (tmp_path / "a.json").write_text(json.dumps({"features": features}))
    parsed = exposure.parsed_notices(feeds.notices(spark, str(tmp_path / "a.json")))
    rows = parsed.collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.closure_type, r.work_window, r.impact_text, r.street_key) == ("lanes closed", "night", "lanes closed northbound", "SWAN")
    assert exposure.spine(parsed).count() == (42 + (r.d_to - r.d_from).days + 1) * 24


def test_road_volumes(spark, tmp_path):
    p = {"Road Segment ID": 1, "Travel Direction": "N", "Calendar Year": 2024, "Road Name": "Swan", "Average Annual Daily Traffic Volume": 10.0}
    far = [[140.0, -30.0], [141.0, -30.0]]
    near = [[144.9, -37.8], [145.0, -37.9]]
    features = [{"geometry": {"type": "LineString", "coordinates": near}, "properties": p}, {"geometry": {"type": "MultiLineString", "coordinates": [near, near]}, "properties": p | {"Road Segment ID": 2}}, {"geometry": {"type": "LineString", "coordinates": far}, "properties": p}, {"geometry": {"type": "LineString", "coordinates": near}, "properties": p | {"Road Segment ID": None}}]
    (tmp_path / "v.json").write_text(json.dumps({"features": features}))
    rows = {r.segment_id: r.lines for r in feeds.road_volumes(spark, str(tmp_path / "v.json")).collect()}
    assert {k: len(v) for k, v in rows.items()} == {1: 1, 2: 2}


def test_sites(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("﻿SITE_NO,SITE_NAME,SITE_TYPE,STATUS,X,Y\n5,A/B,INT,OK,2500000,2500000\n5,,INT,OK,2500000,2500000\nx,C,INT,OK,1,1\n6,D,INT,OK,0,0\n".encode())
    rows = feeds.sites(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.site_no, r.site_name, round(r.site_lat, 6), round(r.site_lon, 6)) for r in rows] == [(5, "A/B", -37.0, 145.0)]


def test_detector_zips(spark, tmp_path):
    head = "NB_SCATS_SITE,QT_INTERVAL_COUNT,NB_DETECTOR," + ",".join(f"V{k:02d}" for k in range(96)) + ",NM_REGION,CT_ALARM_24HOUR\n"
    day = lambda site, v, alarm="": f"{site},2024-01-08,1," + ",".join([str(v)] * 94 + ["-1", ""]) + f",R,{alarm}\n"
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("VSDATA_20240108.csv", "﻿" + head + day(1, 2) + day(2, 3, "1") + day(9, 1))
        z.writestr("VSDATA_20240106.csv", head + day(1, 2))
    for name in ("january_2024.zip",):
        (tmp_path / name).write_bytes(inner.getvalue())
    with zipfile.ZipFile(tmp_path / "annual.zip", "w") as z:
        z.writestr("january_2024.zip", inner.getvalue())
        z.writestr("february_2024.zip", inner.getvalue())
    (tmp_path / "march_2024.zip.part").write_bytes(b"")
    files = feeds.snapshot_files(spark, str(tmp_path))
    assert files.count() == 2
    days = feeds.detector_days(files, {1, 2}, {"january_2024"}, weekdays=True)
    assert days.count() == 2 and feeds.valid_detector_days(days).count() == 1 and feeds.valid_detector_days(days, strict=True).count() == 0
    hours = exposure.hour_slots(feeds.valid_detector_days(days)).orderBy("hour_local").collect()
    assert [(h.volume, h.n_missing) for h in hours[:1] + hours[-1:]] == [(8, 0), (4, 2)]


def test_latest_snapshot(spark, tmp_path):
    for d in ("20240101", "20250101"):
        (tmp_path / d).mkdir()
    assert feeds.latest_snapshot(spark, str(tmp_path)).endswith("20250101")


def test_json_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.23456789)], "k int, v double")
    assert sorted(r.value for r in feeds.json_table(df, {"v": 5}).collect()) == ['{"k":1,"v":null}', '{"k":2,"v":1.23457}']
    feeds.write_sorted_csv(df, str(tmp_path / "c"), F.desc("k"))
    assert [r.k for r in feeds.text_csv(spark, str(tmp_path / "c")).collect()] == ["2", "1"]


def test_exposure_sink(spark, tmp_path):
    df = spark.sql("select date'2024-01-05' d_from, 1 radar_id, 2 site_no, date'2024-01-05' date_local")
    feeds.write_exposure(df, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).where("month = '2024-01'").count() == 1


def test_simulation_files(spark, tmp_path):
    d = tmp_path / "base_h08_s1.0_seed3"
    d.mkdir()
    (d / "tripinfo.xml").write_text('<tripinfos><tripinfo id="a" depart="1" duration="20.5" routeLength="100"/><tripinfo id="b" depart="2" duration="30" routeLength="50"/></tripinfos>')
    (d / "vehroute.xml").write_text('<routes><vehicle id="a" depart="1"><route edges="e1 e2"/></vehicle></routes>')
    (d / "queues.xml").write_text('<q><interval id="q_e1_0" begin="0" maxJamLengthInMeters="5"/><interval id="q_e1_1" begin="0" maxJamLengthInMeters="9"/></q>')
    (d / "edgedata.xml").write_text('<m><interval begin="0" end="300"><edge id="e1" entered="4" departed="1" traveltime="2"/></interval></m>')
    (d / "summary.xml").write_text('<s><step time="1" loaded="1" teleports="0" discarded="0"/><step time="2" loaded="5" teleports="1" discarded="0"/></s>')
    assert {(r.scenario, r.hour, r.seed, r.id, r.duration) for r in xml.trips(spark, str(d / "tripinfo.xml")).collect()} == {("base", 8, 3, "a", 20.5), ("base", 8, 3, "b", 30.0)}
    assert xml.routes(spark, str(d / "vehroute.xml")).first().edges == ["e1", "e2"]
    assert xml.queues(spark, str(d / "queues.xml")).first().jam_m == 9
    assert xml.edge_intervals(spark, str(d / "edgedata.xml")).first().entered == 4
    assert xml.last_step(spark, str(d / "summary.xml")).first().loaded == 5
    counts = spark.createDataFrame([(0.0, 300.0, "e1", 7.0)], "begin double, end double, edge string, entered double")
    xml.write_counts(counts, str(tmp_path / "counts"))
    assert xml.edge_intervals(spark, str(tmp_path / "counts"), keyed=False).first().entered == 7


def test_street_map(spark, tmp_path):
    (tmp_path / "m.osm").write_text('<osm><node id="1" lat="1" lon="2"/><way id="5"><nd ref="1"/><tag k="access" v="no"/></way><relation id="9"><member type="way" ref="5" role=""/><tag k="route" v="bus"/><tag k="ref" v="96"/></relation></osm>')
    nodes, ways, relations = xml.street_map(spark, str(tmp_path / "m.osm"))
    assert nodes.count() == 1 and ways.first().tags == {"access": "no"}
    assert [(r.route, r.ref, r.way) for r in xml.bus_routes_on(relations, ways).collect()] == [(9, "96", 5)]


@pytest.mark.parametrize("colour", [True, False])
def test_las_round_trip(spark, tmp_path, colour):
    rng = np.random.default_rng(0)
    xyz = rng.uniform(0, 50, (500, 3)) + [320000, 5810000, 20]
    rgb = rng.integers(0, 256, (500, 3)) if colour else None
    (tmp_path / "a.las").write_bytes(clouds.las_bytes(xyz, rgb))
    df = clouds.points(spark, str(tmp_path)).orderBy("pid").toPandas()
    assert np.abs(df[["x", "y", "z"]].to_numpy() - xyz).max() < 1e-4
    if colour:
        assert (df[["r", "g", "b"]].to_numpy() == rgb).all()
    again = clouds.las_files(clouds.points(spark, str(tmp_path))).first()
    assert np.abs(clouds.read_las(again.content)[1] - xyz).max() < 2e-4
    assert clouds.points(spark, str(tmp_path), most=100).count() == 100


def test_ply(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    pts = [(0, 1, 2, 10, 20, 30), (3, 4, 5, 1, 2, 3), (6, 7, 8, 0, 0, 255)]
    (tmp_path / "a.ply").write_text(head.format("ascii") + "\n".join(" ".join(map(str, p)) for p in pts) + "\n")
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian").encode() + b"".join(np.array(p[:3], "<f4").tobytes() + bytes(p[3:]) for p in pts))
    rows = clouds.points(spark, str(tmp_path)).orderBy("scan", "pid").collect()
    assert [tuple(r)[2:] for r in rows[:3]] == [tuple(map(float, p[:3])) + p[3:] for p in pts] == [tuple(r)[2:] for r in rows[3:]]


def test_stream_equals_batch(spark, sf, tmp_path):
    from sluice.streaming.hourly import site_hours

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = site_hours(stream, "60 days").writeStream.format("memory").queryName("hours").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.site, r.hour_start): r.n_rows for r in spark.table("hours").groupBy("site", "hour_start").agg(F.max("n_rows").alias("n_rows")).collect()}
    want = {(r.event_type, r.h): r["count"] for r in events.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).count().collect()}
    assert got == want


def test_las_files_moved_and_joined(spark):
    rng = np.random.default_rng(4)
    one, two = rng.uniform(0, 9, (20, 3)), rng.uniform(100, 120, (10, 3))
    rgb = rng.integers(0, 255, (20, 3))
    rows = [(1, "a", clouds.las_bytes(one, rgb)), (1, "b", clouds.las_bytes(two, rgb[:10]))]
    files = spark.createDataFrame(rows, "site int, scan string, content binary")
    motions = spark.createDataFrame([("a", 1.0, 2.0, 90.0, 10.0, -5.0, 2.0), ("b", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "scan string, px double, py double, degrees double, dx double, dy double, scale double")
    moved = clouds.moved_files(files.select("scan", "content"), motions)
    _, xyz, colours = clouds.read_las(bytes(moved.where("scan = 'a'").first().content))
    want = np.column_stack([11 - 2 * (one[:, 1] - 2), -3 + 2 * (one[:, 0] - 1), one[:, 2]])
    assert np.allclose(xyz, want, atol=1e-4) and (colours == rgb).all()
    whole = clouds.joined_files(moved.selectExpr("1 AS site", "scan", "content")).collect()
    _, xyz, colours = clouds.read_las(bytes(whole[0].content))
    assert len(whole) == 1 and np.allclose(xyz, np.concatenate([want, two]), atol=1e-4) and len(colours) == 30
    with pytest.raises(ValueError, match="formats"):
        clouds.join_las([clouds.las_bytes(one), clouds.las_bytes(one, rgb)])


def test_lookup_as_a_table_function(spark):
    from sluice.operators import lookup

    cols = "level int, site_relation string, closure_type string, work_window string, time_band string, road_class string, n_closures long, p10 double, p50 double, p90 double, mean_change double, share_over_15pct_drop double"
    rows = [(1, "same street", "lane", "night", "day", "low", 30, -0.3, -0.1, 0.1, -0.1, 0.2), (2, "same street", "lane", "night", "day", "any", 50, -0.2, -0.05, 0.1, -0.1, 0.2), (3, "cross street", "any", "any", "day", "any", 99, -0.1, 0.0, 0.1, 0.0, 0.1)]
    lookup.sql_function(spark.createDataFrame(rows, cols), "effect_of")
    at = lambda args: spark.sql(f"SELECT level, n_closures FROM effect_of({args})").collect()[0]
    assert tuple(at("'lane', 'night', 'day', 'low'")) == (1, 30)
    assert tuple(at("'lane', 'night', 'day', 'high'")) == (2, 50)
    assert tuple(at("'full', 'night', 'day', 'low', 'cross street'")) == (3, 99)
    with pytest.raises(Exception, match="no lookup row fits"):
        at("'full', 'night', 'day', 'low'")


def _elements(folder):
    """Elements of a folder's files, in the order of the files."""
    import glob
    import xml.etree.ElementTree as ET

    return [e for f in sorted(glob.glob(f"{folder}/part-*")) if (text := open(f).read().strip()) for e in ET.fromstring(text)]


def test_routes_and_trips_in_many_files(spark, tmp_path):
    rows = [(f"v{i}", float((i * 37) % 200) + 0.25, ["a", f"e{i % 7}", "z"]) for i in range(200)] + [("none", 5.0, [])]
    df = spark.createDataFrame(rows, "id string, depart double, edges array<string>")
    xml.write_routes(df, str(tmp_path / "r"), files=3)
    written = _elements(tmp_path / "r")
    assert [(v.get("id")) for v in written] == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert {v.get("id"): v.find("route").get("edges") for v in written} == {r[0]: " ".join(r[2]) for r in rows}
    assert all(v.get("type") == "car" and v.get("departPos") == "random_free" and v.get("depart").endswith(".3") for v in written if v.get("id") != "none")
    back = {r.id: r.edges for r in xml.routes(spark, str(tmp_path / "r"), keyed=False).collect()}
    assert {k: back[k] for k in back if k != "none"} == {r[0]: r[2] for r in rows if r[2]}
    xml.write_trips(df, str(tmp_path / "t"), files=3)
    assert {(t.id, t["from"], t.to) for t in xml.demand_trips(spark, str(tmp_path / "t")).collect()} == {(r[0], "a", "z") for r in rows if r[2]}
    xml.write_vehicle_type(spark, str(tmp_path / "v"))
    assert [e.attrib for e in _elements(tmp_path / "v")] == [xml.CAR]
    xml.write_routes(df.limit(0), str(tmp_path / "empty"))
    assert xml.routes(spark, str(tmp_path / "empty"), keyed=False).count() == 0


def test_connections(spark, tmp_path):
    turns = [("ban", "a", "b", 0, 0), ("ban", "a", "b", 1, 0), ("hook", "c", "d", 2, 1), ("hook", "c", "e", 0, 0), ("ban", None, "b", 0, 0)]
    xml.write_connections(spark.createDataFrame(turns, "kind string, from_edge string, to_edge string, from_lane int, to_lane int"), str(tmp_path / "c"))
    got = sorted(xml.connections(spark, str(tmp_path / "c")).select("change", "from", "to", "fromLane", "toLane").collect(), key=str)
    assert [tuple(r) for r in got] == [("connection", "c", "d", 0, 1), ("delete", "a", "b", None, None), ("delete", "c", "d", 2, 1)]


def test_case_records_round_trip(spark, sf, tmp_path):
    from sluice.operators import cases
    from sluice.plans import closure_cases as plan

    delay, trip = plan._delays(spark, sf)
    r = cases.records(delay, trip, plan._streets(spark, sf), plan._legs(spark, sf), plan._runs(spark, sf)[4])
    feeds.write_records(r, str(tmp_path / "j"))
    back = feeds.read_records(spark, str(tmp_path / "j"), r.schema)
    by = lambda df: sorted(df.collect(), key=lambda x: x.case)
    assert by(back) == by(r) and [x.case for x in by(back)] == plan.CASES
