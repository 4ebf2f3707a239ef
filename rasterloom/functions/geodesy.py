"""Transverse Mercator in Column arithmetic (Krüger series), areas and distances of polygons."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A transverse Mercator grid."""

    lon0: float
    lat0: float
    k0: float
    east: float
    north: float
    a: float = 6378137.0
    f: float = 1 / 298.257222101


# Published parameters of the grids.
ITM = Grid(-8.0, 53.5, 0.99982, 600000.0, 750000.0)
UTM29 = Grid(-9.0, 0.0, 0.9996, 500000.0, 0.0, f=1 / 298.257223563)


def series(g: Grid) -> tuple[float, float, list[float], list[float]]:
    n = g.f / (2 - g.f)
    radius = g.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return n, radius, alpha, beta


def meridian(g: Grid) -> float:
    """Series ordinate of the origin's latitude."""
    n, _, alpha, _ = series(g)
    phi = math.radians(g.lat0)
    e = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi = math.atan(t)
    return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(alpha))


def project(lon: Column, lat: Column, g: Grid = ITM) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    n, radius, alpha, _ = series(g)
    phi, lam = F.radians(lat), F.radians(lon - g.lon0)
    e = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return g.east + g.k0 * radius * x, g.north + g.k0 * radius * (y - meridian(g))


def unproject(east: Column, north: Column, g: Grid = ITM) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    n, radius, _, beta = series(g)
    xi = (north - g.north) / (g.k0 * radius) + meridian(g)
    eta = (east - g.east) / (g.k0 * radius)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    # Krüger's delta: conformal to geodetic latitude
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return g.lon0 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def ring_area(ring: str) -> str:
    """SQL of the signed area of a closed ring, an array of structs x, y."""
    return f"aggregate(sequence(1, size({ring}) - 1), 0D, (s, i) -> s + element_at({ring}, i).x * element_at({ring}, i + 1).y - element_at({ring}, i + 1).x * element_at({ring}, i).y) / 2"


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / F.when(long > 0, long), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def crosses(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether a ray to the east from the point crosses the edge."""
    return ((ay > py) != (by > py)) & (px < (bx - ax) * F.try_divide(py - ay, by - ay) + ax)
