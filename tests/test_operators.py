"""Properties and edge cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwork import registry
from catchwork.functions import geo, text
from catchwork.operators import allocation, cluster, kernel, network, polygon_join, raster, relational, spatial_join
from catchwork.plans.graph import connected_components


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, k) for k in range(1001, 1200)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {k: 1000 for k in range(1000, 1200)}


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest_has_no_radius(spark):
    src = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 0.0), (3, None, 0.0)], "sid long, sx double, sy double")
    tgt = spark.createDataFrame([(10, 1.0, 0.0), (11, -1.0, 0.0), (12, 500.0, 0.0)], "tid long, tx double, ty double")
    got = {r["sid"]: r["tid"] for r in spatial_join.nearest(src, tgt).collect()}
    assert got == {1: 10, 2: 12, 3: None}  # ties: lowest id


def test_nearest_without_targets(spark):
    src = spark.createDataFrame([(1, 0.0, 0.0)], "sid long, sx double, sy double")
    assert spatial_join.nearest(src, spark.createDataFrame([], "tid long, tx double, ty double")).first()["tid"] is None


def test_radius_is_open_or_closed(spark):
    src = spark.createDataFrame([(1, 0.0, 0.0)], "sid long, sx double, sy double")
    tgt = spark.createDataFrame([(2, 3.0, 4.0)], "tid long, tx double, ty double")
    assert spatial_join.within_radius(src, tgt, 5.0).count() == 0
    assert spatial_join.within_radius(src, tgt, 5.0, closed=True).count() == 1


def test_clusters_are_transitive_within_keys(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 1.0, 0.0, 1), (3, 2.0, 0.0, 1), (4, 2.0, 0.0, 2)], "pid long, x double, y double, zone int")
    assert {r["pid"]: r["cluster"] for r in cluster.radius_clusters(p, 1.0, ["zone"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_fullest_row_wins_and_sums(spark):
    df = spark.createDataFrame([(1, 1, None, 5.0), (1, 2, "x", 6.0), (2, 3, None, None)], "cluster long, k long, note string, pop double")
    got = {r["cluster"]: (r["k"], r["note"], r["pop"]) for r in cluster.merge_fullest(df, "cluster", "k", ["pop"]).collect()}
    assert got == {1: (2, "x", 11.0), 2: (3, None, None)}


def test_levels_and_cycles(spark):
    e = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 2), (5, 6), (6, 5), (7, None)], "id long, next_down long")
    got = {r["id"]: (r["level"], r["outlet"]) for r in network.levels(e).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (2, 1), 4: (2, 1), 5: (None, None), 6: (None, None), 7: (0, 7)}


def test_first_common_node(spark):
    e = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 2), (5, 0)], "id long, next_down long")
    m = spark.createDataFrame([(1, 3), (1, 4), (2, 3), (3, 3), (3, 5)], "poly long, src long")
    paths = network.closure(e, m.select("src").distinct(), 100)
    assert {r["poly"]: r["node"] for r in network.first_common(paths, m).collect()} == {1: 2, 2: 3, 3: None}


def test_loads_fall_downstream_and_end_at_cycles(spark):
    rows = [(1, 0, 1, 0.0, 1.0, 250.0, 10.0), (2, 1, 1, 9e6, 1.0, 250.0, 10.0), (3, 4, 2, 1e6, 1.0, 90.0, 0.0), (4, 3, 2, 1e6, 1.0, 90.0, 0.0)]
    s = spark.createDataFrame(rows, "id long, next_down long, main_riv long, pop double, q double, length double, lat double")
    got = {r["id"]: r for r in network.propagate(s, 0.5).collect()}
    assert set(got) == {1, 2}
    assert got[1]["inflow"] == got[2]["outflow"] > 0
    assert got[2]["level"] == 1 and got[1]["ratio"] <= got[2]["ratio"]


def test_served_and_unserved_add_up(spark):
    p = spark.createDataFrame([(float(x) + 0.5, 0.5, 2.9, "a") for x in range(10)] + [(0.5, 0.5, None, "b")], "x double, y double, value double, country string")
    b = spark.createDataFrame([(1, "a", 0.0, 0.0, 3.0, 1.0), (2, "a", 1.0, 0.0, 4.0, 1.0)], "bid long, country string, minx double, miny double, maxx double, maxy double")
    got = {r["country"]: r for r in raster.served_totals(p, b, 2.0, ["country"]).collect()}
    assert (got["a"]["served"], got["a"]["unserved"], got["a"]["total"]) == (8, 12, 20)
    assert got["b"]["total"] == 0 and got["b"]["served_index"] == 0


def test_islands_join_at_corners_or_not(spark):
    p = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 5, 5)], "pid long, row int, col int").withColumn("z", F.lit(1))
    assert raster.islands(p, ["z"]).select("cluster").distinct().count() == 2
    assert raster.islands(p, ["z"], corners=False).select("cluster").distinct().count() == 3


def test_binarised_treats_nan_as_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (-1.0,), (0.2,)], "v double")
    assert [r[0] for r in df.select(raster.binarised(F.col("v"))).collect()] == [0, 0, 0, 1]


def test_zonal_coverage_is_conserved(spark):
    p = spark.createDataFrame([(float(x), float(y), 1.0) for x in range(4) for y in range(4)], "minx double, miny double, value double")
    z = spark.createDataFrame([(1, 0.25, 0.25, 2.75, 3.5)], "bid long, minx double, miny double, maxx double, maxy double")
    r = raster.zonal(p, z, 1.0, 2.0).first()
    assert r["sum"] == pytest.approx(2.5 * 3.25) and r["std"] == 0


@pytest.mark.parametrize("method", ["linear", "log", "sqrt", "sigmoid"])
def test_weights_add_up(spark, method):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 0.0, "a"), (3, None, "a"), (4, 900.0, "a"), (5, 0.0, "b"), (6, None, "c")], "sid long, v double, g string")
    got = allocation.with_weights(df, "v", "g", method).groupBy("g").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1) for r in got) and len(got) == 3


def test_every_cell_has_one_site(spark):
    g = spark.createDataFrame([("a", 0.0, 0.0, 5.0, 4.0)], "g string, minx double, miny double, maxx double, maxy double")
    s = spark.createDataFrame([("a", 1, 1.0, 1.0, 0.5), ("a", 2, 4.0, 3.0, 0.5), ("a", 3, 4.0, 3.0, 0.0)], "g string, sid long, sx double, sy double, weight double")
    cells = allocation.allocate(allocation.grid(g, "g", 1.0), s, "g")
    assert cells.count() == 20 and {r["site"] for r in cells.collect()} == {1, 2}
    rings = {r["site"]: r["rings"] for r in allocation.region_outlines(cells, "g").collect()}
    area = sum(kernel.ring_area(np.array([(p["x"], p["y"]) for p in r])) for rs in rings.values() for r in rs)
    assert area == 20


def test_allocation_queries_take_all_sites(spark, tmp_path):
    keys = range(1, 1001)
    group = lambda k: 2 if k > 600 else k % 2
    spark.createDataFrame([(k, group(k), float(k), "m") for k in keys], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")

    def nearest(country, i, j, distance):
        far = lambda k: math.sqrt((i + 0.5 - k * 37 % 120 / 10) ** 2 + (j + 0.5 - k * 53 % 120 / 10) ** 2)
        return min((distance(far(k), 1.0 + k % 5), k) for k in keys if group(k) == country)[1]

    metrics = {"multiplicative": lambda d, w: d / w, "additive": lambda d, w: math.sqrt(d * d - w * w if d * d - w * w >= 0 else 0.01)}
    for name, metric in metrics.items():
        want = {(c, i, j): nearest(c, i, j, metric) for c in range(3) for i in range(12) for j in range(12)}
        got = {(r["country"], r["i"], r["j"]): r["site"] for r in registry.queries()[f"l7_voronoi_{name}"](spark, str(tmp_path)).collect()}
        assert got == want and max(got.values()) > 600
    areas = {(r["country"], r["site"]): r["n_cells"] for r in registry.queries()["l10_region_areas"](spark, str(tmp_path)).collect()}
    outlines = registry.queries()["l9_region_outlines"](spark, str(tmp_path)).collect()
    assert sum(areas.values()) == 432 and {(r["country"], r["site"]) for r in outlines} == areas.keys()


def test_outline_with_hole_and_corner():
    hole = [(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    rings = allocation.outline(hole)
    assert sorted(kernel.ring_area(np.array(r, float)) for r in rings) == [-1, 9]
    assert len(allocation.outline([(0, 0), (1, 1)])) == 2


def test_wkb_round_trip_and_kernels():
    hole = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]]
    data = kernel.dumps(kernel.POLYGON, hole)
    assert kernel.area(data) == 15
    assert kernel.loads(b"\x01broken") is None and kernel.area(None) is None
    rings = kernel.polygons(data)[0]
    assert kernel.contains(rings, np.array([0.5, 1.5, 5.0]), np.array([0.5, 1.5, 1.0])).tolist() == [True, False, False]
    assert kernel.centroid(kernel.dumps(kernel.POINT, (3.0, 4.0))) == (3.0, 4.0)
    assert abs(kernel.ring_area(kernel.clip_ring(np.array(hole[0][:-1], float), (1, 1, 3, 10)))) == 6
    assert kernel.length_inside(np.array([(0.0, 0.0), (10.0, 0.0)]), (2, -1, 5, 1)) == pytest.approx(3)


def test_first_polygon_keeps_unknown_points(spark):
    box = kernel.dumps(kernel.POLYGON, [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]])
    polys = spark.createDataFrame([(9, bytearray(box)), (4, bytearray(box)), (1, None)], "bid long, geom binary")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0), (3, None, None)], "pid long, x double, y double")
    assert {r["pid"]: r["bid"] for r in polygon_join.first_polygon(pts, polys, 1.0).collect()} == {1: 4, 2: None, 3: None}


def test_shards_are_disjoint_and_exhaustive(spark):
    df = spark.range(1000)
    parts = [relational.shard(df, "id", i, 3).count() for i in range(3)]
    assert sum(parts) == 1000 and min(parts) > 200
    with pytest.raises(ValueError):
        relational.shard(df, "id", 3, 3)


def test_dense_ids_of_many_partitions(spark):
    got = relational.dense_ids(spark.range(500).select((F.col("id") * 7 % 500).alias("k")), ["k"]).collect()
    assert sorted((r["k"], r["idx"]) for r in got) == [(i, i) for i in range(500)]


def test_stratified_sample_backfills(spark):
    df = spark.createDataFrame([(i, "a" if i < 95 else "b") for i in range(100)], "k long, c string")
    got = relational.stratified_sample(df, "c", "k", 20, seed=1).collect()
    assert len(got) == 20 and sum(r["c"] == "b" for r in got) == 5


def test_union_meets_names_by_case(spark):
    a, b = spark.createDataFrame([(1, "x")], "Id long, TAG string"), spark.createDataFrame([(2, 3.0)], "ID long, extra double")
    assert sorted(tuple(r) for r in relational.union_all_by_name([a, b]).select("id", "tag", "extra").collect()) == [(1, "x", None), (2, None, 3.0)]


@pytest.mark.parametrize(("answer", "want"), [("3.Urban: near houses: yes", (3, "Urban", "near houses: yes")), ("no separator", (None, None, None)), ("[x].[y]: [z]", (None, None, None)), ("4.: why", (4, None, "why")), (None, (None, None, None))])
def test_model_answers(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "t string")
    assert tuple(df.select(*text.model_answer(F.col("t"))).first()) == want


def test_utm_against_known_values(spark):
    # the equator and 45 degrees on the central meridian: the meridian arc to 45 degrees is 4984944.378 m on WGS84
    known = [(3.0, 0.0, 32631, 500000.0, 0.0), (3.0, 45.0, 32631, 500000.0, 0.9996 * 4984944.378), (3.0, -45.0, 32731, 500000.0, 1e7 - 0.9996 * 4984944.378)]
    df = spark.createDataFrame([k[:2] for k in known], "lon double, lat double").withColumn("e", geo.utm_epsg(F.col("lon"), F.col("lat")))
    x, y = geo.utm_xy(F.col("lon"), F.col("lat"), F.col("e"))
    for got, want in zip(df.select("e", x.alias("x"), y.alias("y")).collect(), known, strict=True):
        assert got["e"] == want[2] and math.hypot(got["x"] - want[3], got["y"] - want[4]) < 0.01


def test_longitude_180_is_zone_60(spark):
    df = spark.createDataFrame([(180.0, 10.0), (0.0, 89.0), (None, 1.0)], "lon double, lat double")
    assert [r[0] for r in df.select(geo.utm_epsg(F.col("lon"), F.col("lat"))).collect()] == [32660, 3857, 3857]
