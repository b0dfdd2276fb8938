"""Geometry kernels on well-known binary: points, lines and polygons in numpy, and their Arrow-batched columns."""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON = 1, 2, 3, 4, 5, 6


def dumps(kind: int, parts: list) -> bytes:
    """WKB of a point (x, y), a line [(x, y)...], a polygon [ring...], or a multi-geometry [part...]."""
    head = b"\x01" + struct.pack("<I", kind)
    if kind == POINT:
        return head + struct.pack("<2d", *parts)
    if kind == LINE:
        return head + struct.pack("<I", len(parts)) + np.asarray(parts, "<f8").tobytes()
    if kind == POLYGON:
        return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in parts)
    return head + struct.pack("<I", len(parts)) + b"".join(dumps(kind - 3, p) for p in parts)


def _load(data: bytes, at: int) -> tuple[int, list, int]:
    order = "<" if data[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0] % 1000
    at += 5

    def points(at: int) -> tuple[np.ndarray, int]:
        n = struct.unpack_from(order + "I", data, at)[0]
        return np.frombuffer(data, order + "f8", 2 * n, at + 4).reshape(n, 2), at + 4 + 16 * n

    if kind == POINT:
        return kind, list(struct.unpack_from(order + "2d", data, at)), at + 16
    if kind == LINE:
        p, at = points(at)
        return kind, p, at
    n, parts = struct.unpack_from(order + "I", data, at)[0], []
    at += 4
    for _ in range(n):
        if kind == POLYGON:
            p, at = points(at)
        else:
            _, p, at = _load(data, at)
        parts.append(p)
    return kind, parts, at


def loads(data: bytes | None) -> tuple[int, list] | None:
    """(kind, parts) of a WKB value; None for null or broken bytes."""
    try:
        kind, parts, _ = _load(bytes(data), 0)
        return kind, parts
    except (TypeError, IndexError, ValueError, struct.error):
        return None


_NAMES = {"POINT": POINT, "LINESTRING": LINE, "POLYGON": POLYGON, "MULTIPOINT": MULTIPOINT, "MULTILINESTRING": MULTILINE, "MULTIPOLYGON": MULTIPOLYGON}
_WKT = re.compile(r"\s*(?:SRID\s*=\s*\d+\s*;)?\s*([A-Za-z]+)\s*(?:ZM|Z|M)?\s*(\(.*\))\s*", re.S | re.I)


def from_wkt(text: str | None) -> bytes | None:
    """WKB of a well-known text, its first two dimensions; None for null, empty, broken and other kinds."""
    m = _WKT.fullmatch(text or "")
    kind = _NAMES.get(m[1].upper()) if m else None
    if kind is None:
        return None
    try:
        body = re.sub(r"[^\s(),]+(?:\s+[^\s(),]+)+", lambda p: "[" + ",".join(str(float(x)) for x in p[0].split()[:2]) + "]", m[2])
        parts = json.loads(body.replace("(", "[").replace(")", "]"))
        if kind == MULTIPOINT:
            parts = [p[0] if isinstance(p[0], list) else p for p in parts]
        return dumps(kind, parts[0] if kind == POINT else parts)
    except (ValueError, TypeError, IndexError, struct.error):
        return None


def coordinates(parts: list | np.ndarray) -> list[np.ndarray]:
    """All vertices of a decoded geometry, as arrays of (x, y)."""
    if isinstance(parts, np.ndarray):
        return [parts]
    if parts and np.isscalar(parts[0]):
        return [np.array([parts], float)]
    return [a for p in parts for a in coordinates(p)] or [np.zeros((0, 2))]


def polygons(data: bytes | None) -> list[list[np.ndarray]]:
    """The polygons of a WKB value as lists of rings; other kinds have none."""
    g = loads(data)
    if g is None or g[0] not in (POLYGON, MULTIPOLYGON):
        return []
    return [g[1]] if g[0] == POLYGON else g[1]


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def area(data: bytes | None) -> float | None:
    ps = polygons(data)
    return float(sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in ps)) if ps else None


def centroid(data: bytes | None) -> tuple[float, float] | None:
    """A point itself; the mean vertex of a line by length; the area-weighted centroid of polygons."""
    g = loads(data)
    if g is None:
        return None
    if g[0] == POINT:
        return tuple(g[1])
    if g[0] == LINE:
        p = np.asarray(g[1])
        w = np.hypot(*np.diff(p, axis=0).T)
        mid = (p[1:] + p[:-1]) / 2
        return tuple(map(float, mid.T @ w / w.sum())) if w.sum() else tuple(map(float, p[0]))
    total, cx, cy = 0.0, 0.0, 0.0
    for p in polygons(data):
        for k, r in enumerate(p):
            x, y, x1, y1 = r[:, 0], r[:, 1], np.roll(r[:, 0], -1), np.roll(r[:, 1], -1)
            cross = x * y1 - x1 * y
            sign = (1 if k == 0 else -1) * (1 if cross.sum() >= 0 else -1)
            total, cx, cy = total + sign * cross.sum() / 2, cx + sign * ((x + x1) @ cross) / 6, cy + sign * ((y + y1) @ cross) / 6
    return (float(cx / total), float(cy / total)) if total else None


def contains(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie inside a polygon (even-odd rule over its rings)."""
    inside = np.zeros(len(x), bool)
    for r in rings:
        x0, y0, x1, y1 = r[:, 0], r[:, 1], np.roll(r[:, 0], -1), np.roll(r[:, 1], -1)
        for a, b, c, d in zip(x0, y0, x1, y1, strict=True):
            if b != d:
                inside ^= ((b > y) != (d > y)) & (x < (c - a) * (y - b) / (d - b) + a)
    return inside


def clip_ring(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A ring cut to an axis-parallel box, side by side."""
    out = [tuple(p) for p in ring]
    for axis, bound, keep in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        new: list[tuple[float, float]] = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            a, b = keep * (p[axis] - bound), keep * (q[axis] - bound)
            if a >= 0:
                new.append(p)
            if a * b < 0:
                t = a / (a - b)
                new.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = new
        if not out:
            break
    return np.array(out, float).reshape(-1, 2)


def length_inside(line: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """Length of a line's share inside a box."""
    total = 0.0
    for (x0, y0), (x1, y1) in zip(line[:-1], line[1:], strict=True):
        t0, t1, dx, dy = 0.0, 1.0, x1 - x0, y1 - y0
        for p, q in ((-dx, x0 - box[0]), (dx, box[2] - x0), (-dy, y0 - box[1]), (dy, box[3] - y0)):
            if p == 0:
                t0 = t0 if q >= 0 else 2.0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if t0 < t1:
            total += (t1 - t0) * float(np.hypot(dx, dy))
    return total


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def shape_id(g: Column | str, *keys: str) -> Column:
    """A digest by which shapes are the same: equal bytes of the geometry and equal ``keys``; null for a null geometry."""
    own = F.unhex(F.sha2(F.col(g) if isinstance(g, str) else g, 256))
    return F.concat(own, F.unhex(F.sha2(F.to_json(F.struct(*keys)).cast("binary"), 256))) if keys else own


def distinct_shapes(shapes: DataFrame, *keys: str) -> DataFrame:
    """The different geometries of shapes (geom, ``keys``) once each, with ``shape_id`` as bid; null ones go."""
    own = shapes.where("geom is not null").withColumn("bid", shape_id("geom", *keys))
    return own.groupBy("bid").agg(*[F.first(c).alias(c) for c in (*keys, "geom")])


def wkb_kind(g: Column) -> Column:
    """The kind of a geometry as a number: 1 point, 2 line, 3 polygon, 4 to 6 their multiples; null for null."""
    order, first = F.hex(F.substring(g, 1, 1)), lambda at: F.conv(F.hex(F.substring(g, at, 1)), 16, 10).cast("int")
    return F.when(order == "01", first(2)).when(order == "00", first(5))


@F.pandas_udf(T.DoubleType())
def wkb_area(g: pd.Series) -> pd.Series:
    return g.map(area).astype(float)


@F.pandas_udf(_doubles("x", "y"))
def wkb_centroid(g: pd.Series) -> pd.DataFrame:
    c = [centroid(x) or (None, None) for x in g]
    return pd.DataFrame(c, columns=["x", "y"])


@F.pandas_udf(_doubles("x", "y"))
def wkb_largest_centroid(g: pd.Series) -> pd.DataFrame:
    """The centroid of the largest part of a multi-polygon; of other kinds the whole's."""

    def one(data: bytes | None) -> tuple:
        parts = [dumps(POLYGON, p) for p in polygons(data)]
        return centroid(max(parts, key=area) if parts else data) or (None, None)

    return pd.DataFrame([one(x) for x in g], columns=["x", "y"])


@F.pandas_udf(_doubles("minx", "miny", "maxx", "maxy"))
def wkb_bounds(g: pd.Series) -> pd.DataFrame:
    def one(data: bytes | None) -> tuple:
        v = loads(data)
        xy = np.concatenate(coordinates(v[1])) if v else np.zeros((0, 2))
        return (*xy.min(axis=0), *xy.max(axis=0)) if len(xy) else (None,) * 4

    return pd.DataFrame([one(x) for x in g], columns=["minx", "miny", "maxx", "maxy"])


#: Pairs of a point and an edge that are tested at once.
_AT_ONCE = 1 << 18


def _held(edges: list[np.ndarray], rows: list[np.ndarray], x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    """As ``contains``, for the rows of several polygons at once; ``edges``: begins and ends by polygon."""
    if not edges:
        return
    sizes, n = np.array([len(e) for e in edges]), np.array([len(r) for r in rows])
    begins, row = np.repeat(np.cumsum(sizes) - sizes, n), np.concatenate(rows)
    each = np.repeat(sizes, n)
    first = np.cumsum(each) - each
    a, b, c, d = np.concatenate(edges)[np.arange(each.sum()) + np.repeat(begins - first, each)].T
    px, py = np.repeat(x[row], each), np.repeat(y[row], each)
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = ((b > py) != (d > py)) & (px < (c - a) * (py - b) / (d - b) + a)
    out[row] = np.add.reduceat(crossed, first, dtype=np.int64) % 2 == 1


@F.pandas_udf(T.BooleanType())
def wkb_contains(g: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Whether each polygon holds its point; each distinct polygon of a batch is decoded once, small ones are tested together."""
    out, px, py = np.zeros(len(g), bool), x.to_numpy(float), y.to_numpy(float)
    code, shapes = pd.factorize(g)
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(shapes) + 1))
    edges, rows, held = [], [], 0
    for s, data in enumerate(shapes):
        k, parts = order[cuts[s] : cuts[s + 1]], polygons(data)
        size = len(k) * sum(len(r) for p in parts for r in p)
        if len(parts) != 1 or not size or size > _AT_ONCE:
            for rings in parts:
                out[k] |= contains(rings, px[k], py[k])
            continue
        if held + size > _AT_ONCE:
            _held(edges, rows, px, py, out)
            edges, rows, held = [], [], 0
        edges.append(np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for r in parts[0] if len(r)]))
        rows.append(k)
        held += size
    _held(edges, rows, px, py, out)
    return pd.Series(out)


_BOX = np.dtype([("head", "V13"), ("xy", "<f8", (5, 2))])


@F.pandas_udf(T.BinaryType())
def wkb_box(minx: pd.Series, miny: pd.Series, maxx: pd.Series, maxy: pd.Series) -> pd.Series:
    a, b, c, d = (s.to_numpy(float) for s in (minx, miny, maxx, maxy))
    made = np.zeros(len(a), _BOX)
    made["head"] = np.void(b"\x01" + struct.pack("<3I", POLYGON, 1, 5))
    made["xy"] = np.stack([a, b, c, b, c, d, a, d, a, b], axis=1).reshape(-1, 5, 2)
    return pd.Series([x.tobytes() for x in made.view(f"V{_BOX.itemsize}")], dtype=object)


@F.pandas_udf(T.BinaryType())
def wkb_from_wkt(g: pd.Series) -> pd.Series:
    return pd.Series([from_wkt(x) for x in g], dtype=object)


def with_wkb(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``geom``, the WKB of a well-known text; each different text is parsed once, apart from the rows that have it."""
    own = df.withColumn("_text", text)
    parsed = own.select("_text").distinct().withColumn("geom", wkb_from_wkt("_text"))
    return own.join(parsed, "_text", "left").drop("_text")
