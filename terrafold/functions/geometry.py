"""Boxes, rings, affine grids and map projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres a degree, WGS84 and UTM parameters.
METRES_PER_DEGREE = 111_320
WGS84_A, WGS84_F, UTM_SCALE, UTM_EAST, UTM_SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = WGS84_F / (2 - WGS84_F)
_RECTIFIED = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_CONFORMAL = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)


def box_area(x1, y1, x2, y2) -> Column:
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def box_iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 without overlap."""
    inter = box_area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = box_area(*a) + box_area(*b) - inter
    return F.when(union > 0, inter / F.when(union > 0, union)).otherwise(0.0)


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring of (x, y) structs."""
    step = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: ring[i - 1]["x"] * ring[i]["y"] - ring[i]["x"] * ring[i - 1]["y"])
    return F.abs(F.aggregate(step, F.lit(0.0), lambda s, v: s + v)) / 2


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over a closed ring of (x, y) structs."""
    crossing = F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: ((ring[i - 1]["y"] > y) != (ring[i]["y"] > y))
        & (x < F.try_divide((ring[i]["x"] - ring[i - 1]["x"]) * (y - ring[i - 1]["y"]), ring[i]["y"] - ring[i - 1]["y"]) + ring[i - 1]["x"]),
    )
    return F.aggregate(crossing, F.lit(False), lambda odd, c: odd != F.coalesce(c, F.lit(False)))


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def pixel_to_map(col, row, t: tuple, centre: bool = False) -> tuple[Column, Column]:
    """Affine (a, b, c, d, e, f) of a column and row; centre takes the pixel's middle."""
    a, b, c, d, e, f = t
    if centre:
        col, row = col + 0.5, row + 0.5
    return c + col * a + row * b, f + col * d + row * e


def map_to_pixel(x, y, t: tuple) -> tuple[Column, Column]:
    """(row, col) of a map point, truncated toward zero."""
    a, b, c, d, e, f = t
    det = a * e - b * d
    col = ((x - c) * e - (y - f) * b) / det
    row = ((y - f) * a - (x - c) * d) / det
    return row.cast("int"), col.cast("int")


def utm_epsg(lat: Column, lon: Column) -> Column:
    return (F.when(lat >= 0, 32600).otherwise(32700) + ((lon + 180) / 6).cast("int") + 1).cast("int")


def _zone_meridian(epsg: Column) -> Column:
    return F.radians((epsg % 100) * 6 - 183)


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """(easting, northing) by the third-order Krueger series."""
    phi, lam = F.radians(lat), F.radians(lon) - _zone_meridian(epsg)
    e2 = 2 * math.sqrt(_N) / (1 + _N)
    sine = F.sin(phi)
    t = F.sinh(F.atanh(sine) - e2 * F.atanh(e2 * sine))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_FORWARD, 1))
    east = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_FORWARD, 1))
    k = UTM_SCALE * _RECTIFIED
    return UTM_EAST + k * east, F.when(epsg >= 32700, UTM_SOUTH).otherwise(0.0) + k * north


def from_utm(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    k = UTM_SCALE * _RECTIFIED
    xi, eta = (y - F.when(epsg >= 32700, UTM_SOUTH).otherwise(0.0)) / k, (x - UTM_EAST) / k
    xi1 = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_INVERSE, 1))
    eta1 = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_INVERSE, 1))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(_CONFORMAL, 1))
    return F.degrees(_zone_meridian(epsg) + F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def box_bounds(corners: list[tuple[Column, Column]]) -> dict[str, Column]:
    """Bounds and centre of map corners, to eight decimals."""
    xs, ys = F.array(*[c[0] for c in corners]), F.array(*[c[1] for c in corners])
    r = lambda c: F.round(c, 8)
    lo_x, hi_x, lo_y, hi_y = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return {"min_x": r(lo_x), "max_x": r(hi_x), "min_y": r(lo_y), "max_y": r(hi_y), "centre_x": r((lo_x + hi_x) / 2), "centre_y": r((lo_y + hi_y) / 2)}
