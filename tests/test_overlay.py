"""Overlay kernels on shapes that are no boxes, against sampled points; and the cases of broken geometries."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwork.operators import overlay as o
from catchwork.operators.kernel import LINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, area, contains, dumps, from_wkt, polygons

STAR = [(2 + (2 if k % 2 else 0.8) * math.cos(k * math.pi / 5), 2 + (2 if k % 2 else 0.8) * math.sin(k * math.pi / 5)) for k in range(10)]
COMB = [(0, 0), (4, 0), (4, 3), (3, 3), (3, 1), (2, 1), (2, 3), (1, 3), (1, 1), (0, 1)]
RING = [[(0, 0), (5, 0), (5, 5), (0, 5)], [(1, 1), (3, 1), (3, 4), (1, 4)]]


def wkb(*rings):
    return dumps(POLYGON, [[*r, r[0]] for r in rings])


SHAPES = [wkb(STAR), wkb(COMB), wkb(*RING), wkb([(1, 0.5), (4.5, 1), (2, 4.4)]), wkb(COMB[::-1])]


def holds(parts, x, y):
    out = np.zeros(len(x), int)
    for p in parts:
        out += contains([np.array(p)], x, y)
    return out


@pytest.mark.parametrize("a", range(len(SHAPES)))
@pytest.mark.parametrize("b", range(len(SHAPES)))
def test_overlay_of_any_polygons(a, b):
    rng = np.random.default_rng(a * 10 + b)
    x, y = rng.uniform(-1, 6, 4000), rng.uniform(-1, 6, 4000)
    in_a, in_b = (sum(contains(r, x, y) for r in polygons(SHAPES[k])) > 0 for k in (a, b))
    pa, pb = o.pieces(SHAPES[a]), o.pieces(SHAPES[b])
    assert sum(map(o.area_of, pa)) == pytest.approx(area(SHAPES[a]))
    for got, want in ((o.meet(pa, pb), in_a & in_b), (o.minus(pa, pb), in_a & ~in_b), (o.join(pa, pb), in_a | in_b)):
        assert (holds(got, x, y) == want).mean() > 0.999  # no point twice; corners of pieces may round
    assert sum(map(o.area_of, o.meet(pa, pb))) + sum(map(o.area_of, o.minus(pa, pb))) == pytest.approx(area(SHAPES[a]))


def test_lines_buffers_and_distances():
    rng = random.Random(3)
    for shape in SHAPES:
        for _ in range(20):
            p, q = ((rng.uniform(-1, 6), rng.uniform(-1, 6)) for _ in range(2))
            t = (np.arange(20_000) + 0.5) / 20_000
            x, y = p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])
            inside = sum(contains(r, x, y) for r in polygons(shape)) > 0
            line = dumps(LINE, [p, q])
            assert o.length_inside(line, shape) == pytest.approx(inside.mean() * math.dist(p, q), abs=0.01)
            assert (o.distance(line, shape) == 0) == bool(inside.any()) or o.distance(line, shape) < 1e-3
    circle = o.buffered(dumps(POINT, [1.0, 1.0]), 2.0)
    assert sum(map(o.area_of, circle)) == pytest.approx(4 * math.pi, rel=0.01)
    capsule = o.buffered(dumps(LINE, [(0, 0), (3, 0)]), 1.0)
    assert sum(map(o.area_of, capsule)) == pytest.approx(6 + math.pi, rel=0.01)
    square = wkb([(0, 0), (2, 0), (2, 2), (0, 2)])
    assert sum(map(o.area_of, o.buffered(square, 0.5))) == pytest.approx(4 + 4 + math.pi / 4, rel=0.01)
    assert o.distance(dumps(POINT, [5.0, 2.0]), square) == 3.0 and o.distance(dumps(POINT, [1.0, 1.0]), square) == 0.0 and o.distance(None, square) is None


def test_well_known_text():
    assert from_wkt("POINT (1 2)") == from_wkt("SRID=4326; point z(1 2 3)") == dumps(POINT, [1.0, 2.0])
    assert from_wkt("LINESTRING(0 0, 1.5 -2e1)") == dumps(LINE, [(0, 0), (1.5, -20)])
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    text = "(" + ", ".join(f"{x} {y}" for x, y in square) + ")"
    assert from_wkt(f"POLYGON ({text})") == dumps(POLYGON, [square]) and from_wkt(f"MULTIPOLYGON (({text}), ({text}))") == dumps(MULTIPOLYGON, [[square], [square]])
    assert from_wkt("MULTIPOINT ((1 2), (3 4))") == from_wkt("MULTIPOINT (1 2, 3 4)") == dumps(MULTIPOINT, [(1, 2), (3, 4)])
    assert [from_wkt(x) for x in (None, "", "POINT EMPTY", "POINT (1)", "POINT (a b)", "POLYGON ((0 0, 1", "CIRCLE (1 2)")] == [None] * 7


def test_validity():
    assert all(map(o.is_valid, SHAPES)) and o.is_valid(dumps(POINT, [1.0, 2.0]))
    bow = wkb([(0, 0), (2, 2), (2, 0), (0, 2)])
    assert not any(map(o.is_valid, [None, b"broken", bow, dumps(POINT, [math.nan, 1.0]), wkb([(0, 0), (1, 1), (2, 2)])]))


def test_frames_with_nulls_and_empty_tables(spark):
    rows = [(1, "k", SHAPES[0]), (2, "k", SHAPES[1]), (3, "m", SHAPES[2]), (4, "m", None), (5, None, b"broken")]
    left = spark.createDataFrame(rows, "bid long, key string, geom binary")
    none = left.limit(0)
    want = {(a, b): sum(map(o.area_of, o.meet(o.pieces(x), o.pieces(y)))) for a, _, x in rows for b, _, y in rows}
    got = {(r["a"], r["b"]): r["area"] for r in o.overlaps(left, left, 1.5).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 1e-9})
    whole = {r["key"]: r["area"] for r in o.dissolve(left, "key", 1.5).groupBy("key").agg(F.sum("area").alias("area")).collect()}
    assert whole["k"] == pytest.approx(sum(map(o.area_of, o.join(o.pieces(SHAPES[0]), o.pieces(SHAPES[1])))))
    kept = {r["bid"]: r["area"] for r in o.erase(left, left.where("bid = 3"), 1.5).groupBy("bid").agg(F.sum("area").alias("area")).collect()}
    assert kept[1] == pytest.approx(sum(map(o.area_of, o.minus(o.pieces(SHAPES[0]), o.pieces(SHAPES[2]))))) and 3 not in kept
    assert o.overlaps(left, none, 1.5).count() == o.dissolve(none, "key", 1.5).count() == o.erase(none, left, 1.5).count() == 0
    assert o.near_shapes(left, left.where("bid = 3"), 0.5, 1.5).count() == 3
