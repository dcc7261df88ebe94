"""Calendar, text and geometry columns on known values."""

import datetime

import pytest
from pyspark.sql import functions as F

from sluice.functions import calendar, geo, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_easter(spark):
    known = {1961: (4, 2), 1981: (4, 19), 2000: (4, 23), 2008: (3, 23), 2024: (3, 31), 2025: (4, 20), 2026: (4, 5), 2027: (3, 28), 2038: (4, 25), 2049: (4, 18), 2076: (4, 19), 2079: (4, 23)}
    df = spark.createDataFrame([(y,) for y in known], "year int").select("year", calendar.easter_sunday(F.col("year")).alias("d"))
    assert {r.year: (r.d.month, r.d.day) for r in df.collect()} == known


def test_daylight_saving(spark):
    r = one(spark, calendar.local_date(F.lit(1704027600000)).alias("a"), calendar.local_date(F.lit(1719755999000)).alias("b"), calendar.text_instant(F.lit("2024-01-15 00:30:00")).alias("c"), calendar.text_instant(F.lit("nonsense")).alias("d"))
    assert r.a == datetime.date(2024, 1, 1) and r.b == datetime.date(2024, 6, 30)
    assert r.c == datetime.datetime(2024, 1, 14, 13, 30) and r.d is None


def test_hours(spark):
    r = one(spark, *[text.hour_of(F.lit(x)).alias(f"h{i}") for i, x in enumerate(("7am", "10 pm", "07:00", "2200", "12am", "12 pm", "25", "noon"))])
    assert tuple(r) == (7, 22, 7, 22, 0, 12, None, None)
    r = one(spark, calendar.hours_between(F.lit(22), F.lit(5)).alias("a"), calendar.hours_between(F.lit(0), F.lit(24)).alias("b"), calendar.hours_between(F.lit(None).cast("int"), F.lit(5)).alias("c"))
    assert sorted(r.a) == [0, 1, 2, 3, 4, 22, 23] and len(r.b) == 24 and r.c is None


def test_labels(spark):
    r = one(spark, text.hour_label(F.lit(0)), text.hour_label(F.lit(12)), text.hour_label(F.lit(15)), text.about(F.lit(12345.0)), text.about(F.lit(456.0)), text.about(F.lit(7.2)), text.percent(F.lit(0.125)))
    assert tuple(r) == ("midnight", "noon", "3pm", "12,300", "460", "7", "13%")


def test_street_names(spark):
    r = one(spark, text.street_key(F.lit("Swanston Street - Melbourne")), text.bare_name(F.lit("Little La Trobe Street")), text.street_key(F.lit("St Kilda Rd")))
    assert tuple(r) == ("SWANSTON", "LITTLELATROBE", "ST KILDA")


def test_projections(spark):
    r = one(spark, *geo.utm(F.lit(-37.8136), F.lit(144.9631), 55), *geo.conic(F.lit(-37.0), F.lit(145.0)))
    assert r[0] == pytest.approx(320704.4, abs=1) and r[1] == pytest.approx(5812911.7, abs=1)
    assert r[2] == pytest.approx(2_500_000) and r[3] == pytest.approx(2_500_000)
    assert geo.utm_zone(32755) == (55, True) and geo.utm_zone(28355) == (55, True) and geo.utm_zone(4326) is None


def test_geh(spark):
    r = one(spark, geo.geh(F.lit(0.0), F.lit(0.0)), geo.geh(F.lit(110.0), F.lit(100.0)))
    assert r[0] == 0 and r[1] == pytest.approx((2 * 100 / 210) ** 0.5)


def test_hour_slots_without_counts(spark):
    from sluice.operators import exposure

    days = [("full", [1] * 96), ("odd", [None, -1, 5, 7] + [None] * 92), ("short", [2, 2, 2]), ("empty", []), ("none", None)]
    out = exposure.hour_slots(spark.createDataFrame(days, "detector string, slots array<int>")).where("hour_local < 2").collect()
    got = {(r.detector, r.hour_local): (r.volume, r.n_missing) for r in out}
    assert got[("full", 0)] == got[("full", 1)] == (4, 0)
    assert got[("odd", 0)] == (12, 2) and got[("odd", 1)] == (None, 4)
    assert got[("short", 0)] == (6, 1)
    assert all(got[(d, h)] == (None, 4) for d in ("empty", "none") for h in (0, 1))


def test_block_sections_by_hand(spark):
    from sluice.operators import sections

    a, b = ("Main", "east"), ("Cross", "north")
    edges = [("a1", 1, 2, *a), ("a2", 2, 3, *a), ("a3", 3, 4, *a), ("b1", 1, 9, *b), ("r1", 4, 5, None, None), ("r2", 6, 5, "", None), ("c1", 6, 7, "Far", "north"), ("lone", 20, 21, "Lane", None)]
    rows = spark.createDataFrame(edges, "edge string, src int, dst int, name string, way string")
    out = {r.edge: (r.behind, r.ahead) for r in sections.block_sections(rows).collect()}
    assert out["a1"] == out["a2"] == out["a3"] == ("Cross", "Far")
    assert out["b1"] == ("Main", sections.OUTSIDE)
    assert "lone" not in out  # the study area's edge at both ends
    assert sections.block_sections(rows.limit(0)).count() == 0


def test_published_grid_coordinates(spark):
    """Two survey marks with published geographic and grid coordinates, both ways."""
    dms = lambda d, m, s: (abs(d) + m / 60 + s / 3600) * (1 if d >= 0 else -1)
    marks = [(dms(-37, 57, 3.72030), dms(144, 25, 29.52440), 55, 273741.297, 5796489.777), (dms(-37, 39, 10.15610), dms(143, 55, 35.38390), 54, 758173.797, 5828674.340)]
    for lat, lon, zone, east, north in marks:
        r = one(spark, *geo.utm(F.lit(lat), F.lit(lon), zone), *geo.utm_inverse(F.lit(east), F.lit(north), zone))
        assert abs(r[0] - east) < 0.002 and abs(r[1] - north) < 0.002
        assert abs(r[2] - lat) < 2e-8 and abs(r[3] - lon) < 2e-8
