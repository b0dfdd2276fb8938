"""Polygon overlay on well-known binary: intersection, difference, union, dissolve, buffers, and lines within polygons.

A polygon is taken apart into convex pieces (triangles of its outer ring, less its holes); overlay is then clipping of convex pieces
by half-planes. Results are multi-polygons of convex pieces that don't overlap, so areas and lengths add up. Joins meet
on grid cells by ids and bounds; geometries are attached to the pairs afterwards. Groups of any size are dissolved and
erased cell by cell, so that no task holds more than the shapes of a cell.

Null, broken and empty geometries have no pieces: they overlap nothing, and nothing is taken from or added to others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, distinct_shapes, dumps, loads, polygons, shape_id, wkb_bounds
from .spatial_join import boxes_to_cells

Piece = list[tuple[float, float]]
#: Pieces of a smaller area are rounding.
TINY = 1e-12
#: Corners of a round buffer's circle.
CORNERS = 64


def area_of(piece: Piece) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(piece, piece[1:] + piece[:1], strict=True)) / 2


def _side(a: tuple[float, float], b: tuple[float, float], p: tuple[float, float]) -> float:
    """Positive on the left of the line from a to b."""
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _half(piece: Piece, a: tuple[float, float], b: tuple[float, float], keep: int) -> Piece:
    """The part of a convex piece on the left (keep 1) or right (-1) of the line from a to b."""
    out: Piece = []
    sides = [keep * _side(a, b, p) for p in piece]
    for k, p in enumerate(piece):
        q, s, t = piece[k - 1], sides[k], sides[k - 1]
        if s * t < 0:
            w = t / (t - s)
            out.append((q[0] + w * (p[0] - q[0]), q[1] + w * (p[1] - q[1])))
        if s >= 0:
            out.append(p)
    return out if len(out) > 2 and area_of(out) > TINY else []


def common(piece: Piece, other: Piece) -> Piece:
    """The common part of two convex pieces."""
    for a, b in zip(other, other[1:] + other[:1], strict=True):
        if not (piece := _half(piece, a, b, 1)):
            break
    return piece


def _upto(piece: Piece, axis: int, at: float, keep: int) -> Piece:
    """The part of a convex piece below (keep 1) or above (-1) a place on an axis; corners cut there lie on it exactly."""
    out: Piece = []
    sides = [keep * (at - p[axis]) for p in piece]
    for k, p in enumerate(piece):
        q, s, t = piece[k - 1], sides[k], sides[k - 1]
        if s * t < 0:
            f = t / (t - s)
            out.append((at, q[1] + f * (p[1] - q[1])) if axis == 0 else (q[0] + f * (p[0] - q[0]), at))
        if s >= 0:
            out.append(p)
    return out


def strips(piece: Piece, axis: int, size: float) -> Iterator[tuple[int, Piece]]:
    """A convex piece cut by the grid lines of one axis: the number of each strip with its part, where that has an area."""
    low, high = min(p[axis] for p in piece), max(p[axis] for p in piece)
    first, last = math.floor(low / size), math.floor(high / size)
    for k in range(first, last + 1):
        own = piece if k == last else _upto(piece, axis, (k + 1) * size, 1)
        piece = piece if k == last else _upto(piece, axis, (k + 1) * size, -1)
        if len(own) > 2 and area_of(own) > TINY:
            yield k, own
        if len(piece) < 3:
            break


def without(piece: Piece, other: Piece) -> list[Piece]:
    """What a convex piece keeps outside another one, as convex pieces."""
    if not common(piece, other):
        return [piece]
    out = []
    for a, b in zip(other, other[1:] + other[:1], strict=True):
        if outside := _half(piece, a, b, -1):
            out.append(outside)
        if not (piece := _half(piece, a, b, 1)):
            break
    return out


def _ring(ring: np.ndarray) -> Piece:
    """Corners of a ring, counter-clockwise, without repeats."""
    points = [tuple(map(float, p)) for p in ring]
    points = [p for k, p in enumerate(points) if p != points[k - 1]] if len(points) > 1 else points
    return points if len(points) < 3 or area_of(points) >= 0 else points[::-1]


def triangles(ring: Piece) -> list[Piece]:
    """A simple ring as itself, if it is convex, or as triangles by cutting off ears."""
    left, out = list(ring), []
    while len(left) > 3:
        bends = [_side(left[k - 1], p, left[(k + 1) % len(left)]) for k, p in enumerate(left)]
        if min(bends) >= 0:
            break
        for k in sorted(range(len(left)), key=lambda k: bends[k] <= 0):
            a, p, b = left[k - 1], left[k], left[(k + 1) % len(left)]
            if bends[k] <= 0:
                ear = None  # only flat or hollow corners are left: a flat one goes without a triangle
                break
            if not any(min(_side(a, p, q), _side(p, b, q), _side(b, a, q)) >= 0 for q in left if q not in (a, p, b)):
                ear = [a, p, b]
                break
        if ear is None:
            k = max((k for k in range(len(left)) if bends[k] <= 0), key=lambda k: bends[k])
        elif area_of(ear) > TINY:
            out.append(ear)
        del left[k]
    return [*out, left] if len(left) > 2 and area_of(left) > TINY else out


def minus(own: list[Piece], other: list[Piece]) -> list[Piece]:
    for o in other:
        own = [q for p in own for q in without(p, o)]
    return own


def meet(own: list[Piece], other: list[Piece]) -> list[Piece]:
    return [c for p in own for o in other if (c := common(p, o))]


def join(own: list[Piece], other: list[Piece]) -> list[Piece]:
    return own + minus(other, own)


@lru_cache(4096)
def pieces(data: bytes | None) -> list[Piece]:
    """The convex pieces of a polygon or multi-polygon; parts that overlap count once, as the dissolved whole."""
    out: list[Piece] = []
    for rings in polygons(data):
        own = [q for r in rings[:1] for q in triangles(_ring(r))]
        for hole in rings[1:]:
            own = minus(own, triangles(_ring(hole)))
        out = join(out, own) if out else own
    return out


def as_wkb(parts: list[Piece]) -> bytes | None:
    return dumps(MULTIPOLYGON, [[[*p, p[0]]] for p in parts]) if parts else None


def lines_of(data: bytes | None) -> list[np.ndarray]:
    g = loads(data)
    return [] if g is None or g[0] not in (LINE, MULTILINE) else [np.asarray(p, float) for p in ([g[1]] if g[0] == LINE else g[1])]


def _stretch(p: tuple[float, float], q: tuple[float, float], piece: Piece) -> float:
    """The length of the segment from p to q inside a convex piece."""
    low, high = 0.0, 1.0
    for a, b in zip(piece, piece[1:] + piece[:1], strict=True):
        s, t = _side(a, b, p), _side(a, b, q)
        if s < 0 and t < 0:
            return 0.0
        if s < 0 <= t:
            low = max(low, s / (s - t))
        elif t < 0 <= s:
            high = min(high, s / (s - t))
    return max(0.0, high - low) * math.dist(p, q)


def length_inside(line: bytes | None, polygon: bytes | None) -> float:
    """The length of a line inside a polygon."""
    return sum(_stretch(tuple(p), tuple(q), c) for x in lines_of(line) for p, q in zip(x[:-1], x[1:], strict=True) for c in pieces(polygon))


def _disc(x: float, y: float, r: float, corners: int) -> Piece:
    return [(x + r * math.cos(2 * math.pi * k / corners), y + r * math.sin(2 * math.pi * k / corners)) for k in range(corners)]


def _hull(points: Piece) -> Piece:
    out: Piece = []
    for own in (sorted(set(points)), sorted(set(points), reverse=True)):
        start = len(out)
        for p in own:
            while len(out) - start > 1 and _side(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        out.pop()
    return out


def buffered(data: bytes | None, radius: float, corners: int = CORNERS) -> list[Piece]:
    """Everything within a radius of a point, line or polygon; circles have ``corners`` corners."""
    g = loads(data)
    if g is None or radius <= 0:
        return pieces(data)
    if g[0] in (POINT, MULTIPOINT):
        around = [_disc(*p, radius, corners) for p in ([g[1]] if g[0] == POINT else g[1])]
    else:
        paths = lines_of(data) or [r for p in polygons(data) for r in p]
        around = [_hull(_disc(*p, radius, corners) + _disc(*q, radius, corners)) for x in paths for p, q in zip(x[:-1], x[1:], strict=True)]
    out = list(pieces(data))
    for a in around:
        out = join(out, [a])
    return out


def distance(a: bytes | None, b: bytes | None) -> float | None:
    """The least distance of two geometries; 0 where they meet."""

    def parts(data: bytes | None) -> tuple[list[tuple], list[Piece]]:
        g = loads(data)
        if g is None:
            return [], []
        if g[0] in (POINT, MULTIPOINT):
            return [(tuple(p), tuple(p)) for p in ([g[1]] if g[0] == POINT else g[1])], []
        paths = lines_of(data) or [np.vstack([r, r[:1]]) for p in polygons(data) for r in p]
        return [(tuple(p), tuple(q)) for x in paths for p, q in zip(x[:-1], x[1:], strict=True)], pieces(data)

    def to_segment(p: tuple, q: tuple, r: tuple) -> float:
        d2 = (r[0] - q[0]) ** 2 + (r[1] - q[1]) ** 2
        t = 0.0 if d2 == 0 else min(1.0, max(0.0, ((p[0] - q[0]) * (r[0] - q[0]) + (p[1] - q[1]) * (r[1] - q[1])) / d2))
        return math.dist(p, (q[0] + t * (r[0] - q[0]), q[1] + t * (r[1] - q[1])))

    (own, inner), (other, outer) = parts(a), parts(b)
    if not own or not other:
        return None
    for points, area in ((own, outer), (other, inner)):
        if any(all(_side(u, v, points[0][0]) >= 0 for u, v in zip(c, c[1:] + c[:1], strict=True)) for c in area):
            return 0.0
    best = math.inf
    for p, q in own:
        for r, s in other:
            if _side(p, q, r) * _side(p, q, s) < 0 and _side(r, s, p) * _side(r, s, q) < 0:
                return 0.0
            best = min(best, to_segment(p, r, s), to_segment(q, r, s), to_segment(r, p, q), to_segment(s, p, q))
    return best


def is_valid(data: bytes | None) -> bool:
    """Finite coordinates, closed rings of a positive area that don't cross themselves."""
    g = loads(data)
    if g is None:
        return False
    rings = [r for p in polygons(data) for r in p]
    if not all(np.isfinite(np.asarray(r)).all() for r in rings or lines_of(data) or [np.asarray(g[1], float)]):
        return False
    for r in rings:
        p = [tuple(x) for x in r]
        if len(p) < 4 or p[0] != p[-1] or abs(area_of(p[:-1])) <= TINY:
            return False
        edges = list(zip(p[:-1], p[1:], strict=True))
        if any(_side(a, b, c) * _side(a, b, d) < 0 and _side(c, d, a) * _side(c, d, b) < 0 for k, (a, b) in enumerate(edges) for c, d in edges[k + 2 :]):
            return False
    return True


def _binary(f: Callable[[bytes | None, bytes | None], object], kind: T.DataType):
    @F.pandas_udf(kind)
    def column(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(None if x is None else bytes(x), None if y is None else bytes(y)) for x, y in zip(a, b, strict=True)], dtype=object if kind == T.BinaryType() else "float64")

    return column


wkb_intersection = _binary(lambda a, b: as_wkb(meet(pieces(a), pieces(b))), T.BinaryType())
wkb_difference = _binary(lambda a, b: as_wkb(minus(pieces(a), pieces(b))), T.BinaryType())
wkb_union = _binary(lambda a, b: as_wkb(join(pieces(a), pieces(b))), T.BinaryType())
wkb_common_area = _binary(lambda a, b: float(sum(map(area_of, meet(pieces(a), pieces(b))))), T.DoubleType())
wkb_length_inside = _binary(length_inside, T.DoubleType())
wkb_distance = _binary(distance, T.DoubleType())


@F.pandas_udf(T.BinaryType())
def wkb_buffer(g: pd.Series, radius: pd.Series) -> pd.Series:
    return pd.Series([as_wkb(buffered(None if x is None else bytes(x), float(r))) for x, r in zip(g, radius, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def wkb_valid(g: pd.Series) -> pd.Series:
    return pd.Series([is_valid(None if x is None else bytes(x)) for x in g])


@F.pandas_udf(T.BinaryType())
def wkb_line(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([dumps(LINE, [(a, b), (c, d)]) for a, b, c, d in zip(x0, y0, x1, y1, strict=True)])


def _cells(shapes: DataFrame, cell: float, grow: float = 0.0) -> DataFrame:
    """Shapes (bid, geom, ...) with a row for each grid cell that their bounds, grown on all sides, meet."""
    boxed = shapes.withColumn("_b", wkb_bounds("geom")).select("*", "_b.*").drop("_b").where("minx is not null")
    grown = boxed.withColumns({"minx": F.col("minx") - grow, "miny": F.col("miny") - grow, "maxx": F.col("maxx") + grow, "maxy": F.col("maxy") + grow})
    return boxes_to_cells(grown, cell)


def meeting(left: DataFrame, right: DataFrame, cell: float, keys: list[str] | None = None, grow: float = 0.0) -> DataFrame:
    """(a, b, a_geom, b_geom) of shapes (bid, geom) of equal ``keys`` whose bounds meet, the left ones grown by ``grow``, each pair once.

    Only ids and bounds meet in the cells; the geometries join the pairs by id.
    """
    keys = keys or []
    side = lambda d, p, g: _cells(d, cell, g).select(*keys, "_cx", "_cy", *[F.col(c).alias(f"{p}_{c}") for c in ("bid", "minx", "miny", "maxx", "maxy")])
    pairs = side(left, "a", grow).join(side(right, "b", 0.0), [*keys, "_cx", "_cy"]).where("a_minx <= b_maxx and b_minx <= a_maxx and a_miny <= b_maxy and b_miny <= a_maxy")
    corner = lambda c: F.floor(F.greatest(f"a_{c}", f"b_{c}") / cell).cast("long")
    once = pairs.where((F.col("_cx") == corner("minx")) & (F.col("_cy") == corner("miny"))).select(F.col("a_bid").alias("a"), F.col("b_bid").alias("b"))
    own = left.select(F.col("bid").alias("a"), F.col("geom").alias("a_geom"))
    return once.join(own, "a").join(right.select(F.col("bid").alias("b"), F.col("geom").alias("b_geom")), "b")


def overlaps(left: DataFrame, right: DataFrame, cell: float, keys: list[str] | None = None) -> DataFrame:
    """(a, b, area) of polygons (bid, geom) of equal ``keys`` that overlap in an area.

    Different geometries meet once each; their areas are then given to every pair of rows that have them.
    """
    keys = keys or []
    found = meeting(distinct_shapes(left, *keys), distinct_shapes(right, *keys), cell, keys).select("a", "b", wkb_common_area("a_geom", "b_geom").alias("area")).where(F.col("area") > TINY)
    own = lambda d, p: d.select(shape_id("geom", *keys).alias(p), F.col("bid").alias(f"_{p}"))
    return found.join(own(right, "b"), "b").join(own(left, "a"), "a").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "area")


def lines_in_polygons(lines: DataFrame, areas: DataFrame, cell: float, keys: list[str] | None = None) -> DataFrame:
    """(a, b, length) of lines (bid, geom) with the polygons that hold a part of them."""
    found = meeting(lines, areas, cell, keys).select("a", "b", wkb_length_inside("a_geom", "b_geom").alias("length"))
    return found.where(F.col("length") > 0)


def near_shapes(left: DataFrame, right: DataFrame, radius: float, cell: float, keys: list[str] | None = None) -> DataFrame:
    """(a, b, dist) of shapes (bid, geom) of equal ``keys`` at most ``radius`` apart: what a buffer of the left ones meets."""
    found = meeting(left, right, cell, keys, grow=radius).select("a", "b", wkb_distance("a_geom", "b_geom").alias("dist"))
    return found.where(F.col("dist") <= radius)


def in_cells(shapes: DataFrame, cell: float) -> DataFrame:
    """Polygons (bid, geom, ...) cut by the grid: a row (..., _cx, _cy, geom) for each cell that holds a part."""

    @F.pandas_udf(T.BinaryType())
    def cut(g: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
        box = lambda i, j: [(i * cell, j * cell), ((i + 1) * cell, j * cell), ((i + 1) * cell, (j + 1) * cell), (i * cell, (j + 1) * cell)]
        return pd.Series([as_wkb(meet(pieces(bytes(x)), [box(i, j)])) for x, i, j in zip(g, cx, cy, strict=True)], dtype=object)

    spread = _cells(shapes, cell).drop("minx", "miny", "maxx", "maxy")
    return spread.withColumn("geom", cut("geom", "_cx", "_cy")).where("geom is not null")


_SHAPE = T.StructType([T.StructField("geom", T.BinaryType()), T.StructField("area", T.DoubleType())])


def _shapes(found: list[list[Piece]]) -> pd.DataFrame:
    return pd.DataFrame({"geom": pd.Series([as_wkb(p) for p in found], dtype=object), "area": [float(sum(map(area_of, p))) for p in found]})


@F.pandas_udf(_SHAPE)
def _united(lists: pd.Series) -> pd.DataFrame:
    def one(geoms: list[bytes]) -> list[Piece]:
        out: list[Piece] = []
        for g in geoms:
            out = join(out, pieces(bytes(g)))
        return out

    return _shapes([one(x) for x in lists])


@F.pandas_udf(_SHAPE)
def _kept(geom: pd.Series, gone: pd.Series) -> pd.DataFrame:
    return _shapes([minus(pieces(bytes(g)), [p for x in ([] if gs is None else gs) for p in pieces(bytes(x))]) for g, gs in zip(geom, gone, strict=True)])


def dissolve(shapes: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, _cx, _cy, geom, area): the union of the polygons (bid, geom) of each key, by grid cell; areas of a key add up to the union's."""
    parts = in_cells(shapes.select("bid", key, "geom"), cell).groupBy(key, "_cx", "_cy").agg(F.sort_array(F.collect_list("geom")).alias("_all"))
    return parts.select(key, "_cx", "_cy", _united("_all").alias("_s")).select(key, "_cx", "_cy", "_s.geom", "_s.area")


def erase(left: DataFrame, right: DataFrame, cell: float, keys: list[str] | None = None) -> DataFrame:
    """(bid, _cx, _cy, geom, area): what the left polygons (bid, geom) keep outside the right ones of equal ``keys``, by grid cell."""
    at = [*(keys or []), "_cx", "_cy"]
    gone = in_cells(right.select("bid", "geom", *(keys or [])), cell).groupBy(*at).agg(F.sort_array(F.collect_list("geom")).alias("_gone"))
    both = in_cells(left.select("bid", "geom", *(keys or [])), cell).join(gone, at, "left").select("bid", "_cx", "_cy", _kept("geom", "_gone").alias("_s"))
    return both.select("bid", "_cx", "_cy", "_s.geom", "_s.area").where("geom is not null")


def overlay_split(left: DataFrame, zones: DataFrame, cell: float, keys: list[str] | None = None) -> DataFrame:
    """(a, b, area): each left polygon's part in every zone, and, with null b, its part outside all of them."""
    outside = erase(left, zones, cell, keys).groupBy(F.col("bid").alias("a")).agg(F.sum("area").alias("area")).where(F.col("area") > TINY)
    none = F.lit(None).cast(zones.schema["bid"].dataType).alias("b")
    return overlaps(left, zones, cell, keys).unionByName(outside.select("a", none, "area"))
