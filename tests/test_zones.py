"""Polygon zones against sampled points, and broken and empty frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwork.operators import catchments, plumes, polygon_join, zones
from catchwork.operators.kernel import LINE, POLYGON, area, contains, dumps, polygons

STAR = [(2 + (2 if k % 2 else 0.8) * math.cos(k * math.pi / 5), 2 + (2 if k % 2 else 0.8) * math.sin(k * math.pi / 5)) for k in range(10)]
RINGS = dumps(POLYGON, [[*STAR, STAR[0]], [(1.9, 1.9), (2.1, 1.9), (2.1, 2.1), (1.9, 1.9)]])
ROWS = [(1, "a", RINGS), (2, "a", None), (3, "b", b"broken")]


def test_coverage_and_zones(spark):
    shapes = spark.createDataFrame(ROWS, "bid long, country string, geom binary")
    got = {(r["px"], r["py"]): r["share"] for r in zones.coverage(shapes, 0.25, block=4).collect()}
    t = (np.arange(40) + 0.5) / 40 * 0.25
    for (px, py), share in got.items():
        x, y = (v.ravel() for v in np.meshgrid(px * 0.25 + t, py * 0.25 + t))
        assert share == pytest.approx(sum(contains(r, x, y).mean() for r in polygons(RINGS)), abs=0.03)
    assert sum(got.values()) * 0.0625 == pytest.approx(area(RINGS))
    pixels = spark.createDataFrame([(px, py, None if px == 8 else -1.0 if px == 9 else 2.5) for px in range(20) for py in range(20)], "px long, py long, value double")
    z = zones.zonal_in_polygons(pixels, shapes, 0.25).collect()
    assert [r["bid"] for r in z] == [1] and z[0]["sum"] == pytest.approx(sum(s * 2.5 for (px, _), s in got.items() if px not in (8, 9)))
    assert z[0]["count"] == pytest.approx(sum(s for (px, _), s in got.items() if px != 8))
    whole = zones.zonal_in_polygons(pixels, shapes, 0.25, rounded=True).first()
    assert (whole["sum"], whole["count"]) == (round(z[0]["sum"]), int(z[0]["count"]))
    totals = zones.signed_totals(pixels.withColumn("k", F.lit(1)), shapes, 0.25, ["k"]).first()
    assert totals["sum_pos"] == sum(1 if px == 9 else 2 for px, _ in got if px != 8) and totals["sum_pos"] - totals["sum_neg"] == 18 * 20 * 2 + 20
    none = shapes.limit(0)
    assert zones.zonal_in_polygons(pixels, none, 0.25).count() == zones.coverage(none, 0.25).count() == 0
    assert zones.signed_totals(pixels, none, 0.25, []).first()["sum_pos"] == 0


def test_tiles_and_masks(spark):
    shapes = spark.createDataFrame(ROWS, "bid long, country string, geom binary")
    cut = zones.cut_by_tiles(shapes, 9).collect()
    assert sum(area(r["geom"]) for r in cut if r["tile"]) == pytest.approx(area(RINGS)) and sorted(r["bid"] for r in cut if r["tile"] is None) == [2, 3]
    pixels = spark.createDataFrame([(1, "a", 2.5, 2.0), (2, "a", 9.0, 9.0), (3, "b", 2.5, 2.0), (4, "a", None, 1.0)], "pid long, country string, x double, y double")
    assert sorted(r["pid"] for r in zones.masked(pixels, shapes, 1.0, ["country"]).collect()) == [2, 3, 4]
    assert [r["pid"] for r in zones.masked(pixels, shapes, 1.0, ["country"], inside=True).collect()] == [1]
    assert {r["country"]: r["epsg"] for r in polygon_join.group_zone(shapes, "country").collect()} == {"a": 32631, "b": 3857}


def test_settled_overlaps_and_catchments(spark):
    box = lambda a, b: dumps(POLYGON, [[(a, 0), (b, 0), (b, 2), (a, 2), (a, 0)]])
    shapes = spark.createDataFrame([(1, box(0, 4)), (2, box(3, 5)), (3, box(4.5, 6.5)), (4, None)], "bid long, geom binary")
    kept = {r["bid"]: r["area"] for r in catchments.settle_overlaps(shapes, 1.5).groupBy("bid").agg(F.sum("area").alias("area")).collect()}
    assert kept == pytest.approx({1: 6.0, 2: 3.0, 3: 4.0})
    sites = spark.createDataFrame([(1, 0.5, 0.5, "k", 4.0), (2, 3.5, 0.5, "k", 4.0), (3, 0.0, 0.0, "none", 1.0)], "sid long, sx double, sy double, country string, pop double")
    bounds = spark.createDataFrame([(1, "k", box(0, 4)), (2, "empty", box(0, 1))], "bid long, country string, geom binary")
    for name in ("0", "1a", "1c"):
        cut = catchments.catchments(sites, bounds, catchments.APPROACHES[name], "country", "pop", 0.5)
        assert {r["site"]: r["area"] for r in cut.groupBy("site").agg(F.sum("area").alias("area")).collect()} == pytest.approx({1: 4.0, 2: 4.0})


def test_ribbons(spark):
    bent = dumps(LINE, [(0.0, 0.0), (300.0, 0.0), (300.0, 300.0)])
    rows = [(1, bent, 3.0, 50.0), (2, None, 3.0, 50.0), (3, bent, 0.5, 50.0), (4, dumps(LINE, [(0.0, 0.0), (60.0, 0.0)]), 3.0, 50.0), (5, dumps(LINE, [(0.0, 0.0), (0.0, 0.0)]), 3.0, 50.0)]
    got = {(r["id"], r["radius"]): area(r["geom"]) for r in plumes.ribbons(spark.createDataFrame(rows, "id long, geom binary, ratio double, lat double"), 1.0, [10.0, 20.0]).collect()}
    assert got[4, 10.0] == pytest.approx(1200) and got[4, 20.0] == pytest.approx(2400) and got[1, 20.0] > got[1, 10.0] > 8000
    assert {k for k, _ in got} <= {1, 4, 5}
