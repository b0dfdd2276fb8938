"""Polygon zones, masks and catchments: shapes are L-shaped, so that none of the results is that of a box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions import geo as g
from ..operators import catchments, kernel, overlay, plumes, polygon_join, raster, zones
from .base import SITES, Registry, lat, r4, sites, sql_lat, table
from .geo import _EPSG
from .overlays import _union_sql
from .rasters import _LAND, _islands_sql, _land

query = Registry()
#: An L: a wide foot and a narrow stem. The odd thousandths keep corners off the pixels' centres.
_LOW = "x + 0.003::double minx, y + 0.003::double miny, x + 4.003::double maxx, y + 2.003::double maxy"
_STEM = "x + 0.003::double minx, y + 2.003::double miny, x + 2.003::double maxx, y + 4.003::double maxy"
_ELLS = f"(select pid bid, country, {_LOW} from {SITES} union all select pid, country, {_STEM} from {SITES})"
_PIXELS = f"(select col - 180 px, 59 - row py, col - 179.5::double x, 59.5::double - row y, value, country from {_LAND})"


def _ell(x: Column, y: Column) -> Column:
    """The well-known text of the L at a place."""
    at = lambda dx, dy: F.concat_ws(" ", (x + dx).cast("string"), (y + dy).cast("string"))
    ring = [(0.003, 0.003), (4.003, 0.003), (4.003, 2.003), (2.003, 2.003), (2.003, 4.003), (0.003, 4.003), (0.003, 0.003)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[at(*p) for p in ring]), F.lit("))"))


def _ells(spark: SparkSession, d: str) -> DataFrame:
    return kernel.with_wkb(sites(spark, d), _ell(F.col("x"), F.col("y"))).select(F.col("pid").alias("bid"), "country", "geom")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return _land(spark, d).selectExpr("pid", "cast(col - 180 as bigint) px", "cast(59 - row as bigint) py", "col - 179.5D x", "59.5D - row y", "value", "country")


@query(f"select pid, 12.0::double area, round(x + 5.0 / 3 + 0.003, 4) cx, round(y + 5.0 / 3 + 0.003, 4) cy from {SITES}")
def a22_i9_wkt_polygons(spark: SparkSession, d: str) -> DataFrame:
    e = _ells(spark, d).select(F.col("bid").alias("pid"), kernel.wkb_area("geom").alias("area"), kernel.wkb_centroid("geom").alias("c"))
    return e.select("pid", r4("area").alias("area"), r4("c.x").alias("cx"), r4("c.y").alias("cy"))


@query(f"select p.pid, min(b.bid) bid from {SITES} p left join {_ELLS} b on p.x > minx and p.x < maxx and p.y > miny and p.y <= maxy group by 1")
def d2_first_ell(spark: SparkSession, d: str) -> DataFrame:
    return polygon_join.first_polygon(sites(spark, d), _ells(spark, d).select("bid", "geom"), 4.0).select("pid", "bid")


_OUT = f"not exists (select 1 from {_ELLS} b where p.x > minx and p.x < maxx and p.y > miny and p.y < maxy)"


@query(f"select country, count(*)::bigint n, sum(value) as value from {_PIXELS} p where {_OUT} group by 1")
def k2_polygon_mask(spark: SparkSession, d: str) -> DataFrame:
    free = zones.masked(_grid(spark, d), _ells(spark, d).select("bid", "geom"), 4.0)
    return free.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


_W, _H = "least(p.px + 1, b.maxx) - greatest(p.px, b.minx)", "least(p.py + 1, b.maxy) - greatest(p.py, b.miny)"


@query(f"""select country, sum(case when t then v else 0 end)::bigint sum_pos, -sum(case when t then 0 else v end)::bigint sum_neg from (select country, abs(cast(trunc(value) as bigint)) v,
    exists (select 1 from {_ELLS} b where {_W} > 0 and {_H} > 0) t from {_PIXELS} p) group by 1""")
def k3_e10_signed_totals(spark: SparkSession, d: str) -> DataFrame:
    return zones.signed_totals(_grid(spark, d), _ells(spark, d), 1.0, ["country"]).select("country", "sum_pos", "sum_neg")


#: The same shape at eighths of a degree, whose shares and sums are exact in both engines.
_X8, _Y8 = "floor(x * 4) / 4 + 0.125::double", "floor(y * 4) / 4 + 0.125::double"
_LOW8 = f"{_X8} minx, {_Y8} miny, {_X8} + 4 maxx, {_Y8} + 2 maxy"
_STEM8 = f"{_X8} minx, {_Y8} + 2 miny, {_X8} + 2 maxx, {_Y8} + 4 maxy"
_EIGHTHS = f"(select pid bid, country, {_LOW8} from {SITES} union all select pid, country, {_STEM8} from {SITES})"
_COVERED = f"(select b.bid, sum(({_W}) * ({_H}) * greatest(p.value, 0)) s, sum(({_W}) * ({_H})) n, sum(({_W}) * ({_H}) * greatest(p.value, 0) * greatest(p.value, 0)) q from {_PIXELS} p join {_EIGHTHS} b on {_W} > 0 and {_H} > 0 group by 1)"


@query(f"select bid, round(s, 6) as sum, round(n, 6) as count, round(s / n, 9) as mean, round(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 3) as std from {_COVERED}")
def e8_polygon_zones(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda c: F.floor(F.col(c) * 4) / 4 + 0.125
    x, y = corner("x"), corner("y")
    at = lambda dx, dy: F.concat_ws(" ", (x + dx).cast("string"), (y + dy).cast("string"))
    text = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[at(*p) for p in ((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0))]), F.lit("))"))
    z = zones.zonal_in_polygons(_grid(spark, d), kernel.with_wkb(sites(spark, d), text).select(F.col("pid").alias("bid"), "geom"), 1.0)
    return z.select("bid", r4("sum", 6).alias("sum"), r4("count", 6).alias("count"), r4("mean", 9).alias("mean"), r4("std", 3).alias("std"))


_TILE = "(select i || '-' || j || '-5' tile, i / 32.0::double * 360 - 180 tx0, (i + 1) / 32.0::double * 360 - 180 tx1, degrees(atan(sinh(pi() * (1 - 2 * (j + 1) / 32.0::double)))) ty0, degrees(atan(sinh(pi() * (1 - 2 * j / 32.0::double)))) ty1 from generate_series(0, 31) a(i), generate_series(0, 31) b(j))"
_TW, _TH = "least(l.col - 179, tx1) - greatest(l.col - 180, tx0)", "least(60 - l.row, ty1) - greatest(59 - l.row, ty0)"


@query(_islands_sql("abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1") + f""" select cluster, tile, cast(floor(round(sum(({_TW}) * ({_TH})), 9)) as bigint) pixel_count, cast(round(round(sum(({_TW}) * ({_TH}) * greatest(value, 0)), 6)) as bigint) pop_sum
    from c join l on c.pid = l.pid join {_TILE} t on {_TW} > 0 and {_TH} > 0 group by 1, 2 having cast(round(round(sum(({_TW}) * ({_TH}) * greatest(value, 0)), 6)) as bigint) > 0 and floor(round(sum(({_TW}) * ({_TH})), 9)) >= 2""")
def k6_islands_by_tile(spark: SparkSession, d: str) -> DataFrame:
    land = _land(spark, d)
    found = raster.islands(land, ["country"]).select("pid", "cluster").join(land, "pid").selectExpr("cluster", "col - 180D minx", "59D - row miny", "value")
    return zones.island_zones(found, 1.0, 5, 2)


@query(f"select pid, tile, round(sum((least(maxx, tx1) - greatest(minx, tx0)) * (least(maxy, ty1) - greatest(miny, ty0))), 3) area from (select bid pid, * from {_ELLS}) join {_TILE} on least(maxx, tx1) - greatest(minx, tx0) > 0.000001 and least(maxy, ty1) - greatest(miny, ty0) > 0.000001 group by 1, 2")
def i19_i20_cut_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    cut = zones.cut_by_tiles(_ells(spark, d), 5).select(F.col("bid").alias("pid"), "tile", kernel.wkb_area("geom").alias("area"))
    return cut.where("area > 0.0000001").select("pid", "tile", r4("area", 3).alias("area"))


#: Squares of three sizes at quarters of a degree, so that equal areas are equal to the last bit.
_SIZED = f"(select pid, country, floor(x * 4) / 4 minx, floor(y * 4) / 4 miny, floor(x * 4) / 4 + 2 + pid % 3 maxx, floor(y * 4) / 4 + 2 + pid % 3 maxy, pid % 3 big from {SITES})"
_LOST = f"(select a.pid, greatest(a.minx, b.minx) minx, greatest(a.miny, b.miny) miny, least(a.maxx, b.maxx) maxx, least(a.maxy, b.maxy) maxy from {_SIZED} a join {_SIZED} b on a.country = b.country and (b.big < a.big or b.big = a.big and b.pid > a.pid) and a.minx < b.maxx and b.minx < a.maxx and a.miny < b.maxy and b.miny < a.maxy)"


@query(f"select a.pid, round((2 + big) * (2 + big) - coalesce(u.area, 0), 3) area from {_SIZED} a left join {_union_sql('pid', _LOST)} u on a.pid = u.pid where (2 + big) * (2 + big) - coalesce(u.area, 0) > 0.00001")
def i8_settled_overlaps(spark: SparkSession, d: str) -> DataFrame:
    side, x, y = F.lit(2.0) + F.col("pid") % 3, F.floor(F.col("x") * 4) / 4, F.floor(F.col("y") * 4) / 4
    boxes = sites(spark, d).select(F.col("pid").alias("bid"), "country", kernel.wkb_box(x, y, x + side, y + side).alias("geom"))
    kept = catchments.settle_overlaps(boxes, 4.0, ["country"]).groupBy(F.col("bid").alias("pid")).agg(F.sum("area").alias("area"))
    return kept.where("area > 0.00001").select("pid", r4("area", 3).alias("area"))


_OWN = f"(select pid sid, country, x sx, y sy, 1.0::double + pid % 5 weight from {SITES})"
_GAP = "sqrt((a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy))"


def _own(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).selectExpr("pid sid", "country", "x sx", "y sy", "1D + pid % 5 weight", "pop")


@query(f"select sid, round(weight / sum(weight) over (partition by country), 8) weight from {_OWN}")
def l6_initial_weights_multiplicative(spark: SparkSession, d: str) -> DataFrame:
    return catchments.initial_weights(_own(spark, d), "country", "multiplicative", True).select("sid", F.round("weight", 8).alias("weight"))


@query(f"select sid, round(weight * coalesce(avg(near) over (partition by country), 1), 4) weight from (select a.sid, a.country, a.weight, min({_GAP}) near from {_OWN} a left join {_OWN} b on a.country = b.country and a.sid <> b.sid group by 1, 2, 3)")
def l6_initial_weights_additive(spark: SparkSession, d: str) -> DataFrame:
    return catchments.initial_weights(_own(spark, d), "country", "additive", True).select("sid", r4("weight").alias("weight"))


_BOUNDS = f"(select distinct country, 0.0::double minx, 0.0::double miny, 9.5::double maxx, 4.25::double maxy from {SITES} union all select distinct country, 0.0::double, 4.25::double, 4.75::double, 8.0::double from {SITES})"
_HERE = f"(select pid sid, country, cast((pid * 37) % 95 as double) / 10.0::double sx, cast((pid * 53) % 80 as double) / 10.0::double sy from {SITES})"


@query(f"""select country, site, round(sum(w * h), 4) area from (select c.country, c.site, least(c.i + 1, b.maxx) - greatest(c.i, b.minx) w, least(c.j + 1, b.maxy) - greatest(c.j, b.miny) h from
    (select country, i, j, arg_min(sid, struct_pack(d := d, sid := sid)) site from (select s.country, s.sid, i, j, sqrt((i + 0.5::double - sx) * (i + 0.5::double - sx) + (j + 0.5::double - sy) * (j + 0.5::double - sy)) / (1.0::double / count(*) over (partition by s.country, i, j)) d
      from {_HERE} s, generate_series(0, 8) a(i), generate_series(0, 7) b(j) where i + 0.5 < 9.5 and j + 0.5 < 4.25 or i + 0.5 < 4.75) group by 1, 2, 3) c join {_BOUNDS} b on b.country = c.country and b.maxx > c.i and b.minx < c.i + 1 and b.maxy > c.j and b.miny < c.j + 1) group by 1, 2""")
def l8_l10_l11_catchments(spark: SparkSession, d: str) -> DataFrame:
    """Unweighted catchments in an L-shaped bound: the grid's cells are cut to it."""
    s = sites(spark, d).selectExpr("pid sid", "country", "cast((pid * 37) % 95 as double) / 10D sx", "cast((pid * 53) % 80 as double) / 10D sy", "pop")
    ring = [(0, 0), (9.5, 0), (9.5, 4.25), (4.75, 4.25), (4.75, 8), (0, 8), (0, 0)]
    bounds = s.select("country").distinct().select(F.col("country").cast("long").alias("bid"), "country", F.lit(kernel.dumps(kernel.POLYGON, [ring])).alias("geom"))
    cut = catchments.catchments(s, bounds, catchments.APPROACHES["2"], "country", "pop", 1.0)
    return cut.groupBy("country", "site").agg(r4(F.sum("area")).alias("area"))


_RES = repr(512 / 2 * 2 * math.pi * 6378137 / 256 / 2**17)


@query(f"select pid, round(x * 100000 - {_RES}::double, 4) minx, round(y * 100000 - {_RES}::double, 4) miny, round(x * 100000 + {_RES}::double, 4) maxx, round(y * 100000 + {_RES}::double, 4) maxy from {SITES}")
def i17_image_bounds(spark: SparkSession, d: str) -> DataFrame:
    box = g.image_bounds(F.col("x") * 100000, F.col("y") * 100000, 512, 512, 17)
    return sites(spark, d).select("pid", *[r4(c).alias(n) for n, c in zip(("minx", "miny", "maxx", "maxy"), box, strict=True)])


@query(f"select country, case when mx is null or my is null or not my between -80 and 84 then 3857 else case when my >= 0 then 32600 else 32700 end + least(cast(floor((mx + 180) / 6) as int) + 1, 60) end::int epsg from (select country, avg(x + 5.0 / 3 + 0.003) mx, avg(y + 5.0 / 3 + 0.003) my from {SITES} group by 1)")
def i13_group_zone(spark: SparkSession, d: str) -> DataFrame:
    return polygon_join.group_zone(_ells(spark, d), "country").select("country", "epsg")


_DECAY = f"(0.23 * pow(1.047::double, 28 * cos(radians(abs({sql_lat('p_partkey')}))) - 20))"


@query(f"""select id, radius, round(2 * radius * (case when n < 2 then len else 100 * (least(n, floor(reach / 100) + 1) - 1) end), 2) area from (select p_partkey id, p_size, p_size * 40.0::double len, ceil(p_size * 40 / 100.0::double) n, ln(p_size / 10.0::double / 0.95) * 86400 / ({_DECAY} * 200) reach from part),
    (select unnest([250.0::double, 500.0::double]) radius) where p_size >= 10 and case when n < 2 then reach >= len else reach >= 100 end""")
def m5_ribbons(spark: SparkSession, d: str) -> DataFrame:
    """Ribbons of straight segments, whose decay is two hundredfold, so that plumes end within a segment."""
    p = table(spark, d, "part").withColumn("len", F.col("p_size") * 40.0).withColumn("decay", fx.decay_rate(lat("p_partkey")) * 200)
    each = p.withColumn("radius", F.explode(F.array(F.lit(250.0), F.lit(500.0)))).withColumn("geom", overlay.wkb_line(F.lit(0.0), F.lit(0.0), F.col("len") * 0.6, F.col("len") * 0.8))
    cut = each.withColumn("geom", plumes.wkb_ribbon("geom", F.col("p_size") / 10.0, "decay", F.lit(0.95), "radius")).where("geom is not null")
    return cut.select(F.col("p_partkey").alias("id"), "radius", r4(kernel.wkb_area("geom"), 2).alias("area"))


@query(f"select pid, round(x + 5.0 / 3 + 0.003, 4) cx, round(y + 5.0 / 3 + 0.003, 4) cy from {SITES}")
def i4_largest_part_centroid(spark: SparkSession, d: str) -> DataFrame:
    small = F.lit("((100 80, 101 80, 101 81, 100 81, 100 80))")
    parts = sites(spark, d).select("pid", F.concat(F.lit("MULTIPOLYGON ("), small, F.lit(", "), F.replace(_ell(F.col("x"), F.col("y")), F.lit("POLYGON "), F.lit("")), F.lit(")")).alias("t"))
    c = parts.select("pid", kernel.wkb_largest_centroid(kernel.wkb_from_wkt("t")).alias("c"))
    return c.select("pid", r4("c.x").alias("cx"), r4("c.y").alias("cy"))


@query(f"select pid from {SITES} where pid % 4 = 0")
def c16_points_only(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    point = F.concat(F.lit("POINT ("), x, F.lit(" "), y, F.lit(")"))
    text = F.when(F.col("pid") % 4 == 0, point).when(F.col("pid") % 4 == 1, _ell(F.col("x"), F.col("y"))).when(F.col("pid") % 4 == 2, F.lit("POINT (1"))
    s = sites(spark, d).select("pid", kernel.wkb_from_wkt(text).alias("geom"))
    return s.where(kernel.wkb_kind(F.col("geom")) == kernel.POINT).select("pid")


_ZONED = f"(select *, {_EPSG}::int epsg from {SITES})"


@query(f"select p.pid, min(b.pid) bid from {_ZONED} p left join {_ZONED} b on p.epsg = b.epsg and p.x > b.x - 1.5 and p.x < b.x + 1.5 and p.y > b.y - 1.5 and p.y < b.y + 1.5 group by 1")
def d5_first_polygon_in_zone(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d).withColumn("epsg", g.utm_epsg(F.col("x"), F.col("y")))
    areas = s.select(F.col("pid").alias("bid"), "epsg", kernel.wkb_box(F.col("x") - 1.5, F.col("y") - 1.5, F.col("x") + 1.5, F.col("y") + 1.5).alias("geom"))
    return polygon_join.first_polygon(s, areas, 3.0, ["epsg"]).select("pid", "bid")
