"""Rows that share a place or a geometry are met once, and every row still has its result."""

import pytest
from pyspark.sql import functions as F

from catchwork.operators import network, overlay, polygon_join, raster, zones
from catchwork.operators.kernel import POLYGON, dumps, wkb_box


def box(a, b, c, d):
    return dumps(POLYGON, [[(a, b), (c, b), (c, d), (a, d), (a, b)]])


@pytest.fixture
def met(monkeypatch):
    """Watches an operator's inner step: the numbers of rows of the frames that it is given."""

    def watch(module, name):
        seen, step = [], getattr(module, name)

        def watched(*args, **more):
            seen.append([a.count() for a in args if hasattr(a, "sparkSession")])
            return step(*args, **more)

        monkeypatch.setattr(module, name, watched)
        return seen

    return watch


def _crowd(spark):
    """300 points at each of two places, and 300 copies of each of two squares; country 2 has the higher ids."""
    rows = spark.range(600).select(F.col("id").alias("pid"), F.expr("id % 2").alias("country"), F.expr("id % 2 * 10D").alias("x"), F.lit(0.0).alias("y"))
    squares = rows.select((F.col("pid") + 1000).alias("bid"), "country", wkb_box(F.col("x") - 1, F.col("y") - 1, F.col("x") + 1, F.col("y") + 1).alias("geom"))
    return rows, squares


def test_first_polygon_in_zone_of_copies(spark, met):
    points, squares = _crowd(spark)
    seen = met(polygon_join, "points_in_polygons")
    strangers = spark.createDataFrame([(5000, 7, 0.0, 0.0), (5001, None, 0.0, 0.0), (5002, 1, None, 0.0)], "pid long, country long, x double, y double")
    got = polygon_join.first_polygon(points.union(strangers), squares, 2.0, ["country"]).select("pid", "bid").collect()
    assert dict(got) == {k: 1000 + k % 2 for k in range(600)} | {5000: None, 5001: None, 5002: None}
    assert seen == [[3, 2]]


def test_contains_many_shapes_in_a_batch(spark):
    from catchwork.operators.kernel import MULTIPOLYGON, contains, polygons, wkb_contains

    ring = dumps(POLYGON, [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]])
    shapes = [ring, box(0, 0, 2, 2), dumps(MULTIPOLYGON, [[[(0, 0), (1, 0), (0, 1), (0, 0)]], [[(2, 2), (4, 2), (4, 4), (2, 2)]]]), None, b"broken"]
    rows = [(k, g, x / 2, y / 2) for k, g in enumerate(shapes) for x in range(-1, 10) for y in range(-1, 10)]
    df = spark.createDataFrame(rows, "k int, g binary, x double, y double").coalesce(1)
    import numpy as np

    for r in df.select("*", wkb_contains("g", "x", "y").alias("hit")).collect():
        want = any(contains(p, np.array([r["x"]]), np.array([r["y"]]))[0] for p in polygons(r["g"]))
        assert r["hit"] == want, (r["k"], r["x"], r["y"])


def test_zonal_of_copies(spark, met):
    pixels = spark.range(900).selectExpr("cast(id % 3 as double) minx", "0D miny", "case when id % 9 = 0 then null when id % 9 = 1 then -1D else 2D end value")
    boxes = spark.range(500).selectExpr("id bid", "0.5D minx", "0D miny", "2D maxx", "1D maxy")
    seen = met(raster, "boxes_to_cells")
    got = raster.zonal(pixels, boxes, 1.0, 2.0).collect()
    # pixel 0: 200 values of 2, half of each inside; pixel 1: 200 values of 2 and 100 of -1, all inside
    assert len(got) == 500 and {tuple(round(x, 9) for x in r[1:]) for r in got} == {(600.0, 400.0, 1.5, round(0.75**0.5, 9))}
    assert sorted(seen) == [[1], [3]]


def test_signed_totals_of_copies(spark, met):
    shapes = spark.range(400).select(F.col("id").alias("bid"), F.lit(box(0.5, 0.5, 2.5, 1.5)).alias("geom"))
    pixels = spark.range(16).selectExpr("id % 4 px", "id div 4 py", "2.9D value", "1 k")
    seen = met(zones, "in_cells")
    assert tuple(zones.signed_totals(pixels, shapes, 1.0, ["k"]).first()) == (1, 12, -20)
    assert seen == [[1]]


def test_zonal_in_polygons_of_copies(spark, met):
    shapes = spark.range(400).select(F.col("id").alias("bid"), F.lit(box(0.5, 0.5, 2.5, 1.5)).alias("geom"))
    # one zone of two parts, in two rows
    shapes = shapes.union(spark.createDataFrame([(400, box(0, 0, 1, 1)), (400, box(3, 3, 4, 4))], "bid long, geom binary"))
    pixels = spark.range(16).selectExpr("id % 4 px", "id div 4 py", "2D value")
    seen = met(zones, "in_cells")
    got = {r["bid"]: tuple(r[1:]) for r in zones.zonal_in_polygons(pixels, shapes, 1.0).collect()}
    assert got == dict.fromkeys(range(401), (4.0, 2.0, 2.0, 0.0)) and seen == [[3]]


def test_closure_of_over_a_million_rows(spark):
    chain = spark.range(1, 1501).selectExpr("id", "id - 1 next_down")
    paths = network.closure(chain, chain.selectExpr("id src"), 1499)
    assert paths.agg(F.count("*"), F.sum("depth"), F.count_distinct("src", "node")).first()[:] == (1_125_750, 562499750, 1_125_750)
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "id long, next_down long")
    assert network.closure(loop, spark.createDataFrame([(3,)], "src long"), 5).collect() == [(3, 3, 0)]
    for sources, depth in ((loop, 5), (chain, 1498)):
        with pytest.raises(Exception, match="a path of over"):
            network.closure(sources, sources.selectExpr("id src"), depth).collect()


def test_first_polygon_of_copies(spark, met):
    points, squares = _crowd(spark)
    seen = met(polygon_join, "points_in_polygons")
    got = polygon_join.first_polygon(points.drop("country"), squares.drop("country"), 2.0).select("pid", "bid").collect()
    assert dict(got) == {k: 1000 + k % 2 for k in range(600)} and seen == [[2, 2]]


@pytest.mark.parametrize("keys", [[], ["country"]])
def test_overlaps_of_copies(spark, met, keys):
    _, left = _crowd(spark)
    right = left.limit(0).union(spark.createDataFrame([(k, k % 2, box(k % 2 * 10, -1, k % 2 * 10 + 3, 1)) for k in range(40)] + [(99, 0, None)], "bid long, country long, geom binary"))
    seen = met(overlay, "meeting")
    got = [tuple(r) for r in overlay.overlaps(left, right, 2.0, keys).collect()]
    assert sorted(got) == sorted((1000 + a, b, 2.0) for a in range(600) for b in range(40) if a % 2 == b % 2)
    assert seen == [[2, 2]]


def test_first_common_node_over_a_million_rows(spark):
    chain = spark.range(1, 1501).selectExpr("id", "id - 1 next_down")
    members = chain.selectExpr("id % 2 poly", "id src")
    paths = network.closure(chain, members.select("src"), 1499)
    assert {r["poly"]: r["node"] for r in network.first_common(paths, members).collect()} == {0: 2, 1: 1}
