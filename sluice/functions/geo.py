"""Geometry columns: distances, bearings, projections, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)))


def flat_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """On a plane around the second point."""
    return F.hypot((lat1 - lat2) * 110574.0, (lon1 - lon2) * 111320.0 * F.cos(F.radians(lat2)))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment; a segment of no length is its point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(square == 0, 1e-9).otherwise(square)))
    return F.hypot(ax + t * dx - px, ay + t * dy - py)


def along_and_off(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Distance along the axis from a towards b, and the signed offset from it (left positive)."""
    dx, dy = bx - ax, by - ay
    length = F.hypot(dx, dy)
    return ((px - ax) * dx + (py - ay) * dy) / length, ((py - ay) * dx - (px - ax) * dy) / length


def compass(dx: Column, dy: Column) -> Column:
    """N, E, S or W of a direction of travel."""
    quarter = F.floor(F.pmod(F.degrees(F.atan2(dx, dy)) + 45, F.lit(360.0)) / 90)
    return F.element_at(F.array(*[F.lit(c) for c in "NESW"]), (quarter + 1).cast("int"))


def angle_between(a: Column, b: Column) -> Column:
    """Least difference of two bearings in degrees, 0 to 180."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360 - d)


def geh(model: Column, count: Column) -> Column:
    """GEH statistic of a modelled against a counted volume; 0 when both are 0."""
    return F.when(model + count == 0, 0.0).otherwise(F.sqrt(2 * F.pow(model - count, 2) / (model + count)))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def boxes_overlap(xs: Column, ys: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether the bounding box of a line's coordinates touches (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = box
    return (F.array_max(xs) >= x0) & (F.array_min(xs) <= x1) & (F.array_max(ys) >= y0) & (F.array_min(ys) <= y1)


# ---- projections on the GRS80 ellipsoid ----

A, FLAT = 6_378_137.0, 1 / 298.257222101
E2 = FLAT * (2 - FLAT)


def _t(lat: Column) -> Column:
    e = math.sqrt(E2)
    s = e * F.sin(lat)
    return F.tan(math.pi / 4 - lat / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))


def conic(lat: Column, lon: Column, parallels: tuple[float, float] = (-36.0, -38.0), origin: tuple[float, float] = (-37.0, 145.0), false: tuple[float, float] = (2_500_000.0, 2_500_000.0)) -> tuple[Column, Column]:
    """Lambert conformal conic with two parallels; by default Victoria's grid."""
    n, f, rho0 = _conic(parallels, origin)
    rho = A * f * F.pow(F.abs(_t(F.radians(lat))), F.lit(n))
    theta = n * F.radians(lon - origin[1])
    return false[0] + rho * F.sin(theta), false[1] + rho0 - rho * F.cos(theta)


def _conic(parallels: tuple[float, float], origin: tuple[float, float]) -> tuple[float, float, float]:
    e = math.sqrt(E2)

    def m(lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - E2 * math.sin(lat) ** 2)

    def t(lat: float) -> float:
        s = e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    p1, p2, p0 = (math.radians(x) for x in (*parallels, origin[0]))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return n, f, A * f * t(p0) ** n


def conic_inverse(x: Column, y: Column, parallels: tuple[float, float] = (-36.0, -38.0), origin: tuple[float, float] = (-37.0, 145.0), false: tuple[float, float] = (2_500_000.0, 2_500_000.0)) -> tuple[Column, Column]:
    """lat, lon of conic()'s coordinates; five rounds of the latitude's fixed point."""
    n, f, rho0 = _conic(parallels, origin)
    e, sign = math.sqrt(E2), math.copysign(1.0, n)
    dx, dy = x - false[0], rho0 - (y - false[1])
    rho = sign * F.hypot(dx, dy)
    t = F.pow(rho / (A * f), F.lit(1 / n))
    lat = math.pi / 2 - 2 * F.atan(t)
    for _ in range(5):
        s = e * F.sin(lat)
        lat = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return F.degrees(lat), origin[1] + F.degrees(F.atan2(sign * dx, sign * dy) / n)


N3 = FLAT / (2 - FLAT)
RADIUS = A / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64)
_FORWARD = (N3 / 2 - 2 * N3**2 / 3 + 5 * N3**3 / 16, 13 * N3**2 / 48 - 3 * N3**3 / 5, 61 * N3**3 / 240)
_BACK = (N3 / 2 - 2 * N3**2 / 3 + 37 * N3**3 / 96, N3**2 / 48 + N3**3 / 15, 17 * N3**3 / 480)
_LAT = (2 * N3 - 2 * N3**2 / 3 - 2 * N3**3, 7 * N3**2 / 3 - 8 * N3**3 / 5, 56 * N3**3 / 15)


def utm(lat: Column, lon: Column, zone: int, south: bool = True) -> tuple[Column, Column]:
    """Easting and northing, by Krueger's series to the third order."""
    e = math.sqrt(E2)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_FORWARD, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_FORWARD, 1)), F.lit(0.0))
    return 500_000 + 0.9996 * RADIUS * x, (10_000_000 if south else 0) + 0.9996 * RADIUS * y


def utm_inverse(east: Column, north: Column, zone: int, south: bool = True) -> tuple[Column, Column]:
    """lat, lon of UTM coordinates."""
    xi, eta = (north - (10_000_000 if south else 0)) / (0.9996 * RADIUS), (east - 500_000) / (0.9996 * RADIUS)
    x = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BACK, 1)), F.lit(0.0))
    y = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BACK, 1)), F.lit(0.0))
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_LAT, 1)), F.lit(0.0))
    return F.degrees(lat), (6 * zone - 183) + F.degrees(F.atan2(F.sinh(y), F.cos(x)))


def utm_zone(epsg: int) -> tuple[int, bool] | None:
    """Zone and whether south, of the EPSG ranges for WGS84, GDA94 and GDA2020."""
    for first, last, offset, south in ((32601, 32660, 32600, False), (32701, 32760, 32700, True), (28348, 28358, 28300, True), (7846, 7859, 7800, True), (26901, 26923, 26900, False), (25828, 25838, 25800, False)):
        if first <= epsg <= last:
            return epsg - offset, south
    return None
