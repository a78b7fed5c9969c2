"""Geometry on the sphere, the ellipsoid and the plane as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: mean earth radius in metres.
EARTH_RADIUS_M = 6371008.8


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres on the sphere (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def progress(px: Column, py: Column, ox: Column, oy: Column, dx: Column, dy: Column) -> Column:
    """Share of the way from o to d at which p is projected (any real number)."""
    ux, uy = dx - ox, dy - oy
    return ((px - ox) * ux + (py - oy) * uy) / (ux * ux + uy * uy)


def cross_distance(px: Column, py: Column, ox: Column, oy: Column, dx: Column, dy: Column) -> Column:
    """Distance of p from the segment o-d."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress(px, py, ox, oy, dx, dy)))
    return F.hypot(px - (ox + t * (dx - ox)), py - (oy + t * (dy - oy)))


#: WGS 84 semi-major axis and flattening; those of GRS 80 for the European equal-area grid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101


def equal_area(lat: Column, lon: Column, lat0: float = 52.0, lon0: float = 10.0, east: float = 4_321_000.0, north: float = 3_210_000.0) -> tuple[Column, Column]:
    """Easting and northing in metres of the oblique Lambert azimuthal equal-area projection on GRS 80; defaults are the European grid."""
    e2 = GRS80_F * (2 - GRS80_F)
    e = math.sqrt(e2)
    area = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    whole = area(1.0)
    b0 = math.asin(area(math.sin(math.radians(lat0))) / whole)
    radius = GRS80_A * math.sqrt(whole / 2)
    stretch = GRS80_A * math.cos(math.radians(lat0)) / math.sqrt(1 - e2 * math.sin(math.radians(lat0)) ** 2) / (radius * math.cos(b0))
    s = F.sin(F.radians(lat))
    q = (s / (1 - s * s * e2) - F.ln((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - e2)
    b = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), q / whole)))
    turn = F.radians(lon - lon0)
    scale = F.sqrt(2.0 / (1.0 + F.sin(b) * math.sin(b0) + F.cos(b) * F.cos(turn) * math.cos(b0))) * radius
    return scale * stretch * F.cos(b) * F.sin(turn) + east, scale / stretch * (F.sin(b) * math.cos(b0) - F.cos(b) * F.cos(turn) * math.sin(b0)) + north


def _vincenty(b1: np.ndarray, b2: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance by iteration on the auxiliary sphere, and where it has settled; b are reduced latitudes."""
    f, b = WGS84_F, WGS84_A * (1 - WGS84_F)
    s1, c1, s2, c2 = np.sin(b1), np.cos(b1), np.sin(b2), np.cos(b2)
    angle, settled = turn.copy(), np.zeros(len(turn), bool)
    for _ in range(40):
        sin_s = np.hypot(c2 * np.sin(angle), c1 * s2 - s1 * c2 * np.cos(angle))
        cos_s = s1 * s2 + c1 * c2 * np.cos(angle)
        arc = np.arctan2(sin_s, cos_s)
        sin_a = np.divide(c1 * c2 * np.sin(angle), sin_s, out=np.zeros_like(arc), where=sin_s > 0)
        cos2 = 1 - sin_a * sin_a
        mid = cos_s - np.divide(2 * s1 * s2, cos2, out=np.zeros_like(arc), where=cos2 > 1e-15)
        c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        after = turn + (1 - c) * f * sin_a * (arc + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1)))
        settled = (np.abs(after - angle) < 1e-13) & (np.abs(after) < np.pi)
        angle = after
        if settled.all():
            break
    u = cos2 * (WGS84_A**2 - b**2) / b**2
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    less = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid * mid - 1) - small / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)))
    return b * big * (arc - less), settled


def _by_azimuth(b1: np.ndarray, b2: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Distance by halving the azimuth at the start, with integrals along the geodesic by quadrature: slow, and right near antipodes.

    With the start south of the equator and at least as far from it as the end, the longitude reached grows with the azimuth.
    """
    f, b = WGS84_F, WGS84_A * (1 - WGS84_F)
    swap = np.abs(b1) < np.abs(b2)
    b1, b2 = np.where(swap, b2, b1), np.where(swap, b1, b2)
    flip = np.where(b1 > 0, -1.0, 1.0)
    b1, b2 = np.minimum(b1 * flip, -1e-20), b2 * flip
    points, parts = np.polynomial.legendre.leggauss(24)

    def follow(azimuth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sin0 = np.sin(azimuth) * np.cos(b1)
        cos2 = np.sqrt(np.maximum(0, (np.cos(azimuth) * np.cos(b1)) ** 2 + np.cos(b2) ** 2 - np.cos(b1) ** 2))
        start = np.arctan2(np.sin(b1), np.cos(azimuth) * np.cos(b1))
        end = np.arctan2(np.sin(b2), cos2)
        k2 = (1 - sin0 * sin0) * f * (2 - f) / (1 - f) ** 2
        half = (end - start) / 2
        arc = start[:, None] + half[:, None] * (points[None, :] + 1)
        root = np.sqrt(1 + k2[:, None] * np.sin(arc) ** 2)
        longitude = np.arctan2(sin0 * np.sin(end), np.cos(end)) - np.arctan2(sin0 * np.sin(start), np.cos(start))
        lag = f * sin0 * half * (parts * ((2 - f) / (1 + (1 - f) * root))).sum(axis=1)
        return longitude - lag, b * half * (parts * root).sum(axis=1)

    low, high = np.zeros(len(turn)), np.full(len(turn), np.pi)
    for _ in range(60):
        azimuth = (low + high) / 2
        reached, _ = follow(azimuth)
        low, high = np.where(reached < turn, azimuth, low), np.where(reached < turn, high, azimuth)
    return follow((low + high) / 2)[1]


def geodesic_metres(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Length of the shortest geodesic on WGS 84 between arrays of points in degrees; NaN where a coordinate is."""
    reduced = lambda lat: np.arctan((1 - WGS84_F) * np.tan(np.radians(np.clip(lat, -90 + 1e-14, 90 - 1e-14))))
    turn = np.abs(np.radians((lon2 - lon1 + 180) % 360 - 180))
    fine = np.isfinite(lat1) & np.isfinite(lat2) & np.isfinite(turn)
    out = np.full(len(turn), np.nan)
    b1, b2, turn = reduced(lat1[fine]), reduced(lat2[fine]), turn[fine]
    metres, settled = _vincenty(b1, b2, turn)
    if not settled.all():
        metres[~settled] = _by_azimuth(b1[~settled], b2[~settled], turn[~settled])
    out[fine] = metres
    return out


@F.pandas_udf(T.DoubleType())
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Distance in metres on the WGS 84 ellipsoid; null where a coordinate is null."""
    return pd.Series(geodesic_metres(*[s.to_numpy(float, na_value=np.nan) for s in (lat1, lon1, lat2, lon2)]))


def geodesic_detour(lat: Column, lon: Column, origin: tuple[Column, Column], destination: tuple[Column, Column]) -> Column:
    """How much longer the way over a point is than the direct one, on the ellipsoid; never below zero, null where a coordinate is."""
    longer = geodesic(*origin, lat, lon) + geodesic(lat, lon, *destination) - geodesic(*origin, *destination)
    return F.when(longer > 0, longer).when(longer <= 0, 0.0)
