"""Geographic column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius, kilometres per degree, Mercator latitude limit.
EARTH_RADIUS_M = 6371008.8
KM_PER_DEGREE = 111.32
MERCATOR_LAT = 85.0511287798066

# WGS84 ellipsoid and UTM scale (public constants).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(c))


def clamp(x, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(x)))


def round_half_up(x) -> Column:
    """Nearest integer, ties toward +infinity."""
    return F.floor(col(x) + 0.5)


def haversine_m(lng1, lat1, lng2, lat2) -> Column:
    lng1, lat1, lng2, lat2 = map(col, (lng1, lat1, lng2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    b = F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    h = a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b
    # least() skips nulls, so the clamp keeps unknown positions unknown by hand
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(h <= 1.0, h).when(h > 1.0, 1.0)))


def planar_km(lng1, lat1, lng2, lat2) -> Column:
    lng1, lat1, lng2, lat2 = map(col, (lng1, lat1, lng2, lat2))
    kx = KM_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot((lng1 - lng2) * kx, (lat1 - lat2) * KM_PER_DEGREE)


def tile_xf(lng, z) -> Column:
    return (col(lng) + 180) / 360 * F.pow(F.lit(2.0), col(z))


def tile_yf(lat, z) -> Column:
    s = F.sin(F.radians(clamp(lat, -MERCATOR_LAT, MERCATOR_LAT)))
    return (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * F.pow(F.lit(2.0), col(z))


def tile_x(lng, z) -> Column:
    return F.floor(tile_xf(lng, z)).cast("int")


def tile_y(lat, z) -> Column:
    return F.floor(tile_yf(lat, z)).cast("int")


def tile_lng(x, z) -> Column:
    return col(x) / F.pow(F.lit(2.0), col(z)) * 360 - 180


def tile_lat(y, z) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * col(y) / F.pow(F.lit(2.0), col(z))))))


def ground_resolution(lat, z, tile_size=256) -> Column:
    circumference = 2 * math.pi * WGS84_A
    return F.cos(F.radians(col(lat))) * circumference / (F.pow(F.lit(2.0), col(z)) * tile_size)


def epsg_from_mgrs(grid) -> Column:
    zone = F.regexp_extract(col(grid), r"^(\d{1,2})([C-X])", 1)
    band = F.regexp_extract(col(grid), r"^(\d{1,2})([C-X])", 2)
    base = F.when(band >= "N", 32600).otherwise(32700)
    return F.when(zone != "", base + zone.try_cast("int"))


def utm(lng, lat, epsg) -> tuple[Column, Column]:
    """Easting and northing by the third-order Krueger series."""
    lng, lat, epsg = map(col, (lng, lat, epsg))
    n = WGS84_F / (2 - WGS84_F)
    big_a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    ok = epsg.between(32601, 32660) | epsg.between(32701, 32760)
    zone = F.when(ok, epsg % 100).otherwise(
        F.raise_error(F.concat(F.lit("not a UTM EPSG code: "), epsg.cast("string"))).cast("int"))
    c = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    dl = F.radians(lng - (zone * 6 - 183))
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when(epsg >= 32700, 1e7).otherwise(0.0)
    return 5e5 + UTM_K0 * big_a * east, south + UTM_K0 * big_a * north


def segment_projection(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    """Clamped parameter t of the closest point on segment a-b and its planar distance."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, clamp(((px - ax) * dx + (py - ay) * dy) / l2, 0.0, 1.0)).otherwise(0.0)
    return t, F.hypot(px - (ax + t * dx), py - (ay + t * dy))
