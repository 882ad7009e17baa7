"""Geometry on the sphere and the ellipsoid, as Spark columns.

Distances are in metres on a sphere of 6 371 000 m unless a radius is given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0
#: Euler angles (degrees) of the model's rotated pole.
ROTATION = (50.0, 15.0, -90.0)
WGS84_A, WGS84_E = 6378137.0, 0.0818191908426215


def lon_to_360(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon)


def cartesian(lon: Column, lat: Column, radius: float = EARTH_RADIUS) -> tuple[Column, Column, Column]:
    lo, la = F.radians(lon), F.radians(lat)
    return F.cos(la) * F.cos(lo) * radius, F.cos(la) * F.sin(lo) * radius, F.sin(la) * radius


def chord(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS) -> Column:
    """Straight distance through the sphere."""
    a, b = cartesian(lon1, lat1, radius), cartesian(lon2, lat2, radius)
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def haversine(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * radius)


def great_circle(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS) -> Column:
    """By the spherical law of cosines, its argument held in [-1, 1]."""
    return great_circle_of(F.sin(F.radians(lat1)), F.cos(F.radians(lat1)), F.sin(F.radians(lat2)), F.cos(F.radians(lat2)), lon2 - lon1, radius)


def great_circle_of(sin1, cos1, sin2, cos2, dlon, radius: float = EARTH_RADIUS) -> Column:
    """`great_circle` from the sines and cosines of the latitudes and the difference of the longitudes."""
    inner = sin1 * sin2 + cos1 * cos2 * F.cos(F.radians(dlon))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner))) * radius


def degree_distance(lon1, lat1, lon2, lat2) -> Column:
    """Planar distance in degrees, longitudes scaled by the cosine of the middle latitude."""
    dlon = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dlon * dlon + (lat2 - lat1) * (lat2 - lat1))


def rotation_matrix(alpha: float = ROTATION[0], beta: float = ROTATION[1], gamma: float = ROTATION[2]) -> list[list[float]]:
    """Geographic to rotated unit vectors; its transpose goes back."""
    a, b, g = map(math.radians, (alpha, beta, gamma))
    ca, sa, cb, sb, cg, sg = math.cos(a), math.sin(a), math.cos(b), math.sin(b), math.cos(g), math.sin(g)
    return [
        [cg * ca - sg * cb * sa, cg * sa + sg * cb * ca, sg * sb],
        [-sg * ca - cg * cb * sa, -sg * sa + cg * cb * ca, cg * sb],
        [sb * sa, -sb * ca, cb],
    ]


def _turn(lon: Column, lat: Column, m: list[list[float]]) -> tuple[Column, Column]:
    v = cartesian(lon, lat, 1.0)
    x, y, z = (sum((v[k] * row[k] for k in range(3)), F.lit(0.0)) for row in m)
    out_lon = F.when((F.abs(x) < 1e-12) & (F.abs(y) < 1e-12), F.lit(0.0)).otherwise(F.degrees(F.atan2(y, x)))
    return out_lon, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def unrotate(lon: Column, lat: Column, angles: tuple[float, float, float] = ROTATION) -> tuple[Column, Column]:
    """Geographic longitude and latitude of rotated ones; at a pole the longitude is 0."""
    return _turn(lon, lat, [list(c) for c in zip(*rotation_matrix(*angles), strict=True)])


def rotate(lon: Column, lat: Column, angles: tuple[float, float, float] = ROTATION) -> tuple[Column, Column]:
    return _turn(lon, lat, rotation_matrix(*angles))


def unrotation_basis(lon: Column, lat: Column, angles: tuple[float, float, float] = ROTATION) -> tuple[Column, Column, Column, Column]:
    """Coefficients (uu, uv, vu, vv) at geographic places: u = uu*ur + uv*vr, v = vu*ur + vv*vr."""
    m = rotation_matrix(*angles)
    rlon, rlat = (F.radians(x) for x in rotate(lon, lat, angles))
    lo, la = F.radians(lon), F.radians(lat)
    out = []
    for east in (True, False):
        t = (-F.sin(rlon), F.cos(rlon), F.lit(0.0)) if east else (-F.sin(rlat) * F.cos(rlon), -F.sin(rlat) * F.sin(rlon), F.cos(rlat))
        x, y, z = (sum((t[k] * m[k][j] for k in range(3)), F.lit(0.0)) for j in range(3))
        out.append((-x * F.sin(lo) + y * F.cos(lo), -x * F.sin(la) * F.cos(lo) - y * F.sin(la) * F.sin(lo) + z * F.cos(la)))
    (uu, vu), (uv, vv) = out
    return uu, uv, vu, vv


def _stereo_t(lat: Column, e: float) -> Column:
    s = F.sin(lat) * e
    return F.tan(F.lit(math.pi / 4) - lat / 2) / F.pow((F.lit(1.0) - s) / (F.lit(1.0) + s), F.lit(e / 2))


def polar_stereographic(lon: Column, lat: Column, lat_ts: float | None = None, lon0: float = 0.0, south: bool = True, a: float = WGS84_A, e: float = WGS84_E) -> tuple[Column, Column]:
    """Ellipsoidal polar stereographic x, y; without lat_ts the scale at the pole is 1."""
    sign = -1.0 if south else 1.0
    t = _stereo_t(F.radians(lat * sign), e)
    if lat_ts is None:
        rho = t * (2 * a / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e)))
    else:
        c = math.radians(abs(lat_ts))
        m_c = math.cos(c) / math.sqrt(1 - (e * math.sin(c)) ** 2)
        t_c = math.tan(math.pi / 4 - c / 2) / ((1 - e * math.sin(c)) / (1 + e * math.sin(c))) ** (e / 2)
        rho = t * (a * m_c / t_c)
    d = F.radians(lon - lon0)
    return rho * F.sin(d), rho * F.cos(d) * (-sign)


def inverse_polar_stereographic(x: Column, y: Column, lat_ts: float = -70.0, lon0: float = 0.0, a: float = WGS84_A, e: float = WGS84_E) -> tuple[Column, Column]:
    """Longitude and latitude (degrees) of southern (lat_ts < 0) or northern polar stereographic metres."""
    south = lat_ts < 0
    c = math.radians(abs(lat_ts))
    m_c = math.cos(c) / math.sqrt(1 - (e * math.sin(c)) ** 2)
    t_c = math.tan(math.pi / 4 - c / 2) / ((1 - e * math.sin(c)) / (1 + e * math.sin(c))) ** (e / 2)
    t = F.sqrt(x * x + y * y) * (t_c / (a * m_c))
    chi = F.lit(math.pi / 2) - F.atan(t) * 2
    e2, e4, e6, e8 = e**2, e**4, e**6, e**8
    lat = chi + F.sin(chi * 2) * (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) + F.sin(chi * 4) * (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) + F.sin(chi * 6) * (7 * e6 / 120 + 81 * e8 / 1120) + F.sin(chi * 8) * (4279 * e8 / 161280)
    lon = F.degrees(F.atan2(x, y) if south else F.atan2(x, -y)) + lon0
    lon = F.when(lon > 180, lon - 360).when(lon <= -180, lon + 360).otherwise(lon)
    return lon, F.degrees(lat) * (-1.0 if south else 1.0)


def grid_cell_area(lat: Column, dlat: float = 1.0, dlon: float = 1.0, radius_km: float = 6371.0) -> Column:
    """Area in square metres of a regular cell centred at `lat`."""
    north, south = F.radians(lat + dlat / 2), F.radians(lat - dlat / 2)
    return (F.sin(north) - F.sin(south)) * (radius_km**2 * math.radians(dlon) * 1e6)


def triangle_area(lons: list[Column], lats: list[Column], radius_m: float = 6_367_500.0) -> Column:
    """Planar area of a small triangle: longitudes made cyclic and scaled by the mean cosine of latitude."""
    near = lambda x, ref: F.when(x - ref > 180, x - 360).when(x - ref < -180, x + 360).otherwise(x)
    lo = [lons[0], near(lons[1], lons[0]), near(lons[2], lons[0])]
    scale = (F.cos(F.radians(lats[0])) + F.cos(F.radians(lats[1])) + F.cos(F.radians(lats[2]))) / 3
    x = [F.radians(v) * radius_m * scale for v in lo]
    y = [F.radians(v) * radius_m for v in lats]
    return F.abs((x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])) / 2


def in_triangle(px: Column, py: Column, xs: list[Column], ys: list[Column], tolerance: float = 0.0) -> Column:
    """Whether the point lies in the triangle by barycentric coordinates; false for a degenerate one."""
    d = (ys[1] - ys[2]) * (xs[0] - xs[2]) + (xs[2] - xs[1]) * (ys[0] - ys[2])
    l1 = F.try_divide((ys[1] - ys[2]) * (px - xs[2]) + (xs[2] - xs[1]) * (py - ys[2]), d)
    l2 = F.try_divide((ys[2] - ys[0]) * (px - xs[2]) + (xs[0] - xs[2]) * (py - ys[2]), d)
    l3 = F.lit(1.0) - l1 - l2
    return F.coalesce((F.abs(d) >= 1e-12) & (l1 >= -tolerance) & (l2 >= -tolerance) & (l3 >= -tolerance), F.lit(False))
