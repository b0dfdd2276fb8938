"""Spatial joins: distance, nearest, containment and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import polygon_join, spatial_join
from ..operators.kernel import wkb_box
from .base import COUNTRIES, SITES, TARGETS, Registry, countries, r4, sites, targets

query = Registry()
_DIST = "sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))"
_SQUARES = f"(select pid bid, country, x - 1.5::double minx, y - 1.5::double miny, x + 1.5::double maxx, y + 1.5::double maxy from {SITES})"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).selectExpr("pid sid", "x sx", "y sy", "country")


def _squares(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).selectExpr("pid bid", "country", "x - 1.5D minx", "y - 1.5D miny", "x + 1.5D maxx", "y + 1.5D maxy")


@query(f"select pid sid, tid, round({_DIST}, 4) dist from {SITES} s join {TARGETS} t on {_DIST} < 6")
def d8_distance_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.within_radius(_sources(spark, d), targets(spark, d), 6.0).withColumn("dist", r4("dist"))


@query(f"select pid sid, tid, round({_DIST}, 4) dist from {SITES} s join {TARGETS} t on s.country = t.country and {_DIST} < 30")
def d8_distance_equi_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.within_radius(_sources(spark, d), targets(spark, d), 30.0, ["country"]).withColumn("dist", r4("dist"))


@query(f"""select pid sid, best.tid tid, round(best.dist, 4) dist from (select s.pid, min(struct_pack(dist := {_DIST}, tid := t.tid)) best from {SITES} s, {TARGETS} t group by 1)""")
def d9_nearest(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.nearest(_sources(spark, d), targets(spark, d)).withColumn("dist", r4("dist"))


@query(f"""select s.pid sid, best.tid tid, round(best.dist, 4) dist from {SITES} s left join (select s.pid, min(struct_pack(dist := {_DIST}, tid := t.tid)) best from {SITES} s join {TARGETS} t on {_DIST} < 5 group by 1) b on s.pid = b.pid""")
def d10_nearest_within(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.nearest_within(_sources(spark, d), targets(spark, d), 5.0).withColumn("dist", r4("dist"))


@query(f"select tid from (select tid, tx + 1.7::double tx, ty from {TARGETS}) t where not exists (select 1 from {SITES} s where {_DIST} <= 1)")
def d12_anti_distance_join(spark: SparkSession, d: str) -> DataFrame:
    beside = targets(spark, d).withColumn("tx", F.col("tx") + 1.7)  # a target shares its key, and so its place, with a site
    return spatial_join.unmatched_targets(_sources(spark, d), beside, 1.0).select("tid")


@query(f"select pid, bid, name from {SITES} left join {COUNTRIES} on x >= minx and x < maxx and y >= miny and y < maxy")
def d1_country_assignment(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.points_in_boxes(sites(spark, d), countries(spark, d), 7.0, how="left").select("pid", "bid", "name")


@query(f"select p.pid, b.bid from {SITES} p join {_SQUARES} b on p.country = b.country and p.x > minx and p.x < maxx and p.y > miny and p.y < maxy")
def d3_equi_spatial_join(spark: SparkSession, d: str) -> DataFrame:
    b = _squares(spark, d).withColumn("geom", wkb_box("minx", "miny", "maxx", "maxy")).select("bid", "country", "geom")
    return polygon_join.points_in_polygons(sites(spark, d).where("x is not null"), b, 3.0, ["country"])


@query(f"select p.pid, min(b.bid) bid from {SITES} p left join {_SQUARES} b on p.x > minx and p.x < maxx and p.y > miny and p.y < maxy group by 1")
def d4_first_polygon(spark: SparkSession, d: str) -> DataFrame:
    b = _squares(spark, d).withColumn("geom", wkb_box("minx", "miny", "maxx", "maxy")).select("bid", "geom")
    return polygon_join.first_polygon(sites(spark, d), b, 3.0).select("pid", "bid")


@query(f"select a.bid a, b.bid b from {_SQUARES} a join {_SQUARES} b on a.bid < b.bid and a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy")
def d6_box_overlap_self_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.overlapping_boxes(_squares(spark, d), 3.0)


@query(f"select bid, count(*)::bigint n from {SITES} join {COUNTRIES} on x >= minx and x < maxx group by 1 having count(*) > 1")
def e5_match_counts(spark: SparkSession, d: str) -> DataFrame:
    hit = spatial_join.points_in_boxes(sites(spark, d), countries(spark, d), 7.0)
    return hit.groupBy("bid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
