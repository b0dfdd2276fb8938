"""Polygon overlay: common areas, differences, dissolves, buffers, lines and distances."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network, overlay
from ..operators.kernel import POINT, dumps, wkb_area, wkb_box
from .base import COUNTRIES, SITES, TARGETS, Registry, countries, r4, sites, targets

query = Registry()
_SQUARES = f"(select pid, country, x - 1.5::double minx, y - 1.5::double miny, x + 1.5::double maxx, y + 1.5::double maxy from {SITES})"
_HOLES = f"(select tid, country, tx - 0.5::double minx, ty - 0.5::double miny, tx + 1.0::double maxx, ty + 1.0::double maxy from {TARGETS})"
_W, _H = "least(a.maxx, b.maxx) - greatest(a.minx, b.minx)", "least(a.maxy, b.maxy) - greatest(a.miny, b.miny)"


def _box(df: DataFrame, x: str, y: str, low: float, high: float) -> DataFrame:
    return df.withColumn("geom", wkb_box(F.col(x) - low, F.col(y) - low, F.col(x) + high, F.col(y) + high))


def _squares(spark: SparkSession, d: str) -> DataFrame:
    return _box(sites(spark, d), "x", "y", 1.5, 1.5).select(F.col("pid").alias("bid"), "country", "geom")


def _holes(spark: SparkSession, d: str) -> DataFrame:
    return _box(targets(spark, d), "tx", "ty", 0.5, 1.0).select(F.col("tid").alias("bid"), "country", "geom")


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return countries(spark, d).select("bid", wkb_box("minx", "miny", "maxx", "maxy").alias("geom"))


def _union_sql(key: str, boxes: str) -> str:
    """The area of each key's union of boxes: strips between neighbouring x, covered lengths of y."""
    return f"""(with b as (select * from {boxes}), x as (select {key}, minx x from b union select {key}, maxx from b),
      s as (select {key}, x a, lead(x) over (partition by {key} order by x) z from x),
      c as (select s.{key}, a, z, miny, maxy, max(maxy) over (partition by s.{key}, a order by miny, maxy rows between unbounded preceding and 1 preceding) reach from s join b on b.{key} = s.{key} and b.minx <= a and b.maxx >= z where z is not null)
      select {key}, sum((z - a) * greatest(0, maxy - greatest(miny, coalesce(reach, miny)))) area from c group by 1)"""


@query(f"select a.pid a, b.tid b, round(({_W}) * ({_H}), 4) area from {_SQUARES} a join {_HOLES} b on {_W} > 0.000001 and {_H} > 0.000001")
def i7_common_area(spark: SparkSession, d: str) -> DataFrame:
    return overlay.overlaps(_squares(spark, d), _holes(spark, d), 3.0).where("area > 0.0000001").select("a", "b", r4("area").alias("area"))


@query(f"select country, round(area, 3) area from {_union_sql('country', _SQUARES)}")
def e3_dissolved_area(spark: SparkSession, d: str) -> DataFrame:
    return overlay.dissolve(_squares(spark, d), "country", 6.0).groupBy("country").agg(r4(F.sum("area"), 3).alias("area"))


_CUT = f"(select a.pid, greatest(a.minx, b.minx) minx, greatest(a.miny, b.miny) miny, least(a.maxx, b.maxx) maxx, least(a.maxy, b.maxy) maxy from {_SQUARES} a join {_HOLES} b on a.country = b.country and {_W} > 0 and {_H} > 0)"


@query(f"select a.pid, round(9 - coalesce(u.area, 0), 4) area from {SITES} a left join {_union_sql('pid', _CUT)} u on a.pid = u.pid")
def d18_difference(spark: SparkSession, d: str) -> DataFrame:
    left = overlay.erase(_squares(spark, d), _holes(spark, d), 3.0, ["country"])
    return left.groupBy(F.col("bid").alias("pid")).agg(r4(F.sum("area")).alias("area"))


_PARTS = f"(select a.pid a, b.bid b, ({_W}) * ({_H}) area from {_SQUARES} a join {COUNTRIES} b on {_W} > 0.000001 and {_H} > 0.000001)"


@query(f"select a, b, round(area, 4) area from {_PARTS} union all select pid, null, round(9 - coalesce(inside, 0), 4) from {SITES} left join (select a, sum(area) inside from {_PARTS} group by 1) on a = pid where 9 - coalesce(inside, 0) > 0.00001")
def d25_overlay_split(spark: SparkSession, d: str) -> DataFrame:
    return overlay.overlay_split(_squares(spark, d), _zones(spark, d), 14.0).where("area > 0.00001").select("a", "b", r4("area").alias("area"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two corners, up to 20 degrees long."""
    s = sites(spark, d)
    return s.select(F.col("pid").alias("bid"), overlay.wkb_line("x", "y", F.col("x") + F.col("pid") % 21 - 10, F.col("y") + F.col("pid") % 7 - 3).alias("geom"))


_DX, _DY = "(pid % 21 - 10)", "(pid % 7 - 3)"
_T0 = f"greatest(0.0::double, case when {_DX} > 0 then (minx - x) / {_DX} when {_DX} < 0 then (maxx - x) / {_DX} else 0 end, case when {_DY} > 0 then (miny - y) / {_DY} when {_DY} < 0 then (maxy - y) / {_DY} else 0 end)"
_T1 = f"least(1.0::double, case when {_DX} > 0 then (maxx - x) / {_DX} when {_DX} < 0 then (minx - x) / {_DX} else 1 end, case when {_DY} > 0 then (maxy - y) / {_DY} when {_DY} < 0 then (miny - y) / {_DY} else 1 end)"
_INSIDE = f"(select pid, bid, ({_T1} - {_T0}) * sqrt({_DX} * {_DX} + {_DY} * {_DY}) len from {SITES} join {COUNTRIES} on ({_DX} <> 0 or (x >= minx and x <= maxx)) and ({_DY} <> 0 or (y >= miny and y <= maxy)) and {_T1} > {_T0})"


@query(f"select pid a, bid b, round(len, 4) length from {_INSIDE} where len > 0.00001")
def d7_lines_in_polygons(spark: SparkSession, d: str) -> DataFrame:
    return overlay.lines_in_polygons(_paths(spark, d), _zones(spark, d), 14.0).where("length > 0.00001").select("a", "b", r4("length").alias("length"))


@query(f"select pid id, arg_max(bid, struct_pack(l := round(len, 6), b := -bid)) basin, round(max(round(len, 6)), 4) length from {_INSIDE} where len > 0.00001 group by 1")
def n1_basin_of_lines(spark: SparkSession, d: str) -> DataFrame:
    parts = overlay.lines_in_polygons(_paths(spark, d), _zones(spark, d), 14.0).where("length > 0.00001")
    best = network.longest_overlap(parts.select(F.col("a").alias("id"), F.col("b").alias("basin"), F.round("length", 6).alias("length")))
    return best.select("id", "basin", r4("length").alias("length"))


_GAPX, _GAPY = "greatest(0, a.minx - b.maxx, b.minx - a.maxx)", "greatest(0, a.miny - b.y, b.y - a.maxy)"


@query(f"select a.pid a, b.tid b, round(sqrt(({_GAPX}) ** 2 + ({_GAPY}) ** 2), 4) dist from {_SQUARES} a join (select tid, country, tx minx, tx + 2 maxx, ty y from {TARGETS}) b on a.country = b.country and sqrt(({_GAPX}) ** 2 + ({_GAPY}) ** 2) <= 4")
def d8_n2_polygons_near_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = targets(spark, d).select(F.col("tid").alias("bid"), "country", overlay.wkb_line("tx", "ty", F.col("tx") + 2, "ty").alias("geom"))
    return overlay.near_shapes(_squares(spark, d), lines, 4.0, 4.0, ["country"]).select("a", "b", r4("dist").alias("dist"))


@query(f"select pid, round({overlay.CORNERS / 2 * math.sin(2 * math.pi / overlay.CORNERS)!r}::double * (pid % 5 + 1) * (pid % 5 + 1), 4) area from {SITES}")
def i6_round_buffer(spark: SparkSession, d: str) -> DataFrame:
    here = dumps(POINT, [1.0, 2.0])
    s = sites(spark, d).select("pid", overlay.wkb_buffer(F.lit(here), (F.col("pid") % 5 + 1).cast("double")).alias("geom"))
    return s.select("pid", r4(wkb_area("geom")).alias("area"))


@query(f"select pid, pid % 3 <> 0 as valid from {SITES}")
def c5_valid_geometry(spark: SparkSession, d: str) -> DataFrame:
    right = F.when(F.col("pid") % 3 == 0, F.col("x")).otherwise(F.col("x") + 1)  # without a width there is no area
    return sites(spark, d).select("pid", overlay.wkb_valid(wkb_box("x", "y", right, F.col("y") + 1)).alias("valid"))
