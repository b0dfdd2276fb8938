"""Coordinate and geometry expressions as columns: projection, tiles, boxes and angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid, UTM scale and false origins.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60; longitude 180 belongs to zone 60."""
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def in_utm_range(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-80, 84), F.lit(False))


def utm_epsg(lon: Column, lat: Column, fallback: int | None = 3857) -> Column:
    """EPSG code of the UTM zone; outside UTM's range the fallback, or an error if there is none."""
    code = F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)
    outside = F.lit(fallback) if fallback is not None else F.raise_error(F.lit("position outside the range of UTM")).cast("int")
    return F.when(in_utm_range(lon, lat), code).otherwise(outside).cast("int")


def utm_xy(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in metres (Krueger series to the third order) in the zone of ``epsg``."""
    middle = F.radians((epsg % 100) * 6.0 - 183.0)
    phi, lam = F.radians(lat), F.radians(lon) - middle
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when((epsg >= 32700) & (epsg < 32800), 10_000_000.0).otherwise(0.0)
    return 500_000.0 + _K0 * _RECT * x, south + _K0 * _RECT * y


def mercator_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web-Mercator metres."""
    return F.radians(lon) * _A, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * _A


def mercator_pixel(x: Column, y: Column, cx: Column, cy: Column, size: int, metres: float, wrap: bool = True) -> tuple[Column, Column]:
    """Pixel of a Web-Mercator position in a square image about (cx, cy) of ``metres`` a side; the date line is wrapped."""
    world = 2 * math.pi * _A
    dx = x - cx
    if wrap:
        dx = F.when(dx > world / 2, dx - world).when(dx < -world / 2, dx + world).otherwise(dx)
    scale = size / metres
    return F.bround(dx * scale + size / 2).cast("int"), F.bround((cy - y) * scale + size / 2).cast("int")


def image_bounds(cx: Column, cy: Column, width: int, height: int, zoom: int) -> tuple[Column, Column, Column, Column]:
    """(minx, miny, maxx, maxy), in Web-Mercator metres, of an image of so many pixels about a position in metres."""
    metres = 2 * math.pi * _A / 256 / 2**zoom
    return cx - width * metres / 2, cy - height * metres / 2, cx + width * metres / 2, cy + height * metres / 2


def tile_x(lon: Column, zoom: int) -> Column:
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * (1 << zoom)), F.lit(0)), F.lit((1 << zoom) - 1)).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    return F.least(F.greatest(F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * (1 << zoom)), F.lit(0)), F.lit((1 << zoom) - 1)).cast("int")


def tiles_of_box(minx: Column, miny: Column, maxx: Column, maxy: Column, zoom: int) -> Column:
    """Names ``x-y-z`` of all tiles that a lon/lat box meets."""
    xs, ys = F.sequence(tile_x(minx, zoom), tile_x(maxx, zoom)), F.sequence(tile_y(maxy, zoom), tile_y(miny, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.concat_ws("-", x.cast("string"), y.cast("string"), F.lit(str(zoom))))))


def tile_box(tile: Column) -> tuple[Column, Column, Column, Column]:
    """(minx, miny, maxx, maxy) of a tile name, in degrees."""
    parts = F.split(tile, "-")
    x, y, n = F.get(parts, F.lit(0)).cast("double"), F.get(parts, F.lit(1)).cast("double"), F.pow(F.lit(2.0), F.get(parts, F.lit(2)).cast("double"))
    north = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return x / n * 360 - 180, north(y + 1), (x + 1) / n * 360 - 180, north(y)


def line_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Direction from the first to the last vertex, in degrees."""
    return F.degrees(F.atan2(y1 - y0, x1 - x0))


def box_around(x: Column, y: Column, half: Column | float) -> tuple[Column, Column, Column, Column]:
    return x - half, y - half, x + half, y + half


def ring_area(ring: Column) -> Column:
    """Signed area of a ring: an array of structs x, y; the last vertex joins the first."""
    n = F.size(ring)
    at = lambda i: F.get(ring, F.pmod(i, n))
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid (struct x, y); the mean vertex of a ring without area."""
    n = F.size(ring)
    at = lambda i: F.get(ring, F.pmod(i, n))
    add = lambda a, t: a + t

    def moment(c: str) -> Column:
        terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (at(i)[c] + at(i + 1)[c]) * (at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"]))
        return F.aggregate(terms, F.lit(0.0), add)

    def mean(c: str) -> Column:
        return F.aggregate(F.transform(ring, lambda p: p[c]), F.lit(0.0), add) / n

    area = ring_area(ring)
    return F.struct(F.coalesce(F.try_divide(moment("x"), 6 * area), mean("x")).alias("x"), F.coalesce(F.try_divide(moment("y"), 6 * area), mean("y")).alias("y"))


def overpass_bbox(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """``miny,minx,maxy,maxx``; null if any side is."""
    known = minx.isNotNull() & miny.isNotNull() & maxx.isNotNull() & maxy.isNotNull()
    return F.when(known, F.concat_ws(",", *[c.cast("string") for c in (miny, minx, maxy, maxx)]))

