"""Geodesy and flight geometry expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
_A, _F, _K0 = 6_378_137.0, 1 / 298.257223563, 0.9996


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing of a vector, in degrees from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def compass(dx: Column, dy: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.pmod(F.floor(bearing(dx, dy) / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def utm_zone(lon: Column) -> Column:
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series to the third order (millimetres within a zone)."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    artanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(artanh(s) - F.lit(e) * artanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), artanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + _K0 * radius * east, F.when(lat >= 0, F.lit(0.0)).otherwise(F.lit(10_000_000.0)) + _K0 * radius * north


def ring_area(ring: Column) -> Column:
    """Area of a closed or open ring: array of (x, y)."""
    rolled = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, rolled, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring, by crossings of the ray to the east."""
    rolled = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, rolled, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))))
    return F.pmod(F.size(F.filter(crosses, lambda c: F.coalesce(c, F.lit(False)))), F.lit(2)) == 1


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    return (degrees + minutes / 60 + seconds / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1)


def gsd_cm(altitude_m: Column, sensor_mm: Column, focal_mm: Column, width_px: Column) -> Column:
    return F.when((focal_mm > 0) & (width_px > 0), altitude_m * sensor_mm / (focal_mm * width_px) * 100)


def forward_overlap(spacing_m: Column, along_m: Column) -> Column:
    return F.when(along_m > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - spacing_m / along_m)))


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear interpolation through knots of rising x; NULL outside."""
    out = F.when(x < knots[0][0], F.lit(None).cast("double"))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out
