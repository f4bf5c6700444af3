"""Projected coordinates, areas and centroids as column expressions on the WGS 84 ellipsoid.

Transverse Mercator by Krüger's series in the third flattening (to the third
power: below a tenth of a millimetre within a zone), and the equal-area cylinder.
Nothing leaves whole-stage code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.operators.geometry import haversine, segments_of
from thalweg.operators.shapes import sides_of

#: Major half axis and flattening of WGS 84, scale and false easting and northing of UTM.
A, FLAT = 6378137.0, 1 / 298.257223563
SCALE, EAST, NORTH = 0.9996, 500_000.0, 10_000_000.0
_N = FLAT / (2 - FLAT)
_R = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(FLAT * (2 - FLAT))
#: Krüger's coefficients, forward, backward, and from conformal to geographic latitude.
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def zone_of(lon: Column) -> Column:
    """UTM zone, 1 to 60, by the longitude alone."""
    return (F.floor((F.pmod(lon + 180, F.lit(360.0))) / 6) + 1).cast("int")


def _total(coefficients, term) -> Column:
    out = F.lit(0.0)
    for k, c in enumerate(coefficients, 1):
        out = out + F.lit(c) * term(2 * k)
    return out


def to_utm(lon: Column, lat: Column, zone: Column | int, south: Column | bool = False) -> tuple[Column, Column]:
    """(easting, northing) in metres of the zone; with ``south`` northings count from ten million at the equator."""
    zone, south = (v if isinstance(v, Column) else F.lit(v) for v in (zone, south))
    away = F.radians(lon - (zone * 6 - 183))
    k, s = 2 * math.sqrt(_N) / (1 + _N), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    x, y = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east = EAST + SCALE * _R * (y + _total(_FORWARD, lambda j: F.cos(j * x) * F.sinh(j * y)))
    north = F.when(south, NORTH).otherwise(0.0) + SCALE * _R * (x + _total(_FORWARD, lambda j: F.sin(j * x) * F.cosh(j * y)))
    return east, north


def from_utm(east: Column, north: Column, zone: Column | int, south: Column | bool = False) -> tuple[Column, Column]:
    """(lon, lat) in degrees of UTM coordinates."""
    zone, south = (v if isinstance(v, Column) else F.lit(v) for v in (zone, south))
    x0, y0 = (north - F.when(south, NORTH).otherwise(0.0)) / (SCALE * _R), (east - EAST) / (SCALE * _R)
    x = x0 - _total(_BACK, lambda j: F.sin(j * x0) * F.cosh(j * y0))
    y = y0 - _total(_BACK, lambda j: F.cos(j * x0) * F.sinh(j * y0))
    c = F.asin(F.sin(x) / F.cosh(y))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(c + _total(_LATITUDE, lambda j: F.sin(j * c)))


def to_equal_area(lon: Column, lat: Column, parallel: float = 30.0) -> tuple[Column, Column]:
    """(x, y) in metres on the equal-area cylinder that is true at ``parallel``."""
    k = math.cos(math.radians(parallel)) / math.sqrt(1 - (_E * math.sin(math.radians(parallel))) ** 2)
    s = F.sin(F.radians(lat))
    q = (1 - _E**2) * (s / (1 - _E**2 * s * s) + F.atanh(_E * s) / _E)
    return A * k * F.radians(lon), A * q / (2 * k)


def ring_measures(rings: DataFrame, id: str = "id", planar: bool = False) -> DataFrame:
    """(id, area, x, y): area and area-weighted centroid of each id's rings together.

    Degrees give square kilometres on the ellipsoid (sides run straight on the
    equal-area cylinder) and a centroid in degrees; ``planar`` leaves units as
    they are. Rings run one way and holes the other, as everywhere here; ids
    whose rings have no area have no centroid. Sums over sides, so no task holds
    a ring.
    """
    s = sides_of(rings.where(F.col("ring").isNotNull()), id)
    first = s.groupBy(F.col(id).alias("_id")).agg(F.min("x1").alias("_x"), F.min("y1").alias("_y"))  # sums are taken from there, not from far away
    s = s.join(first, F.col(id) == F.col("_id"))
    a, b, c, d = (F.col(v) - F.col(o) for v, o in (("x1", "_x"), ("y1", "_y"), ("x2", "_x"), ("y2", "_y")))
    cross = a * d - c * b
    sums = [F.sum(cross).alias("w"), F.sum((a + c) * cross).alias("wx"), F.sum((b + d) * cross).alias("wy")]
    if planar:
        area = F.abs(F.col("w")) / 2
    else:
        (x1, y1), (x2, y2) = to_equal_area(F.col("x1"), F.col("y1")), to_equal_area(F.col("x2"), F.col("y2"))
        sums.append(F.sum((x1 * y2 - x2 * y1) / 2e6).alias("km2"))
        area = F.abs(F.col("km2"))
    out = s.groupBy(id, "_x", "_y").agg(*sums)
    centre = lambda o, v: F.col(o) + F.try_divide(F.col(v), 3 * F.col("w"))
    return out.select(id, area.alias("area"), centre("_x", "wx").alias("x"), centre("_y", "wy").alias("y"))


def line_centroids(lines: DataFrame, id: str = "subc_id", planar: bool = False) -> DataFrame:
    """(id, x, y): the middles of a line's pieces, weighted by their lengths; lines without length have none."""
    p = segments_of(lines, id)
    weight = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) if planar else haversine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    p = p.select("id", weight.alias("w"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return p.groupBy(F.col("id").alias(id)).agg(*[F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum("w")).alias(c) for c in ("x", "y")])
