"""Composites: input preparation, assignment by zone, validation against other figures, and tile risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..functions import geo as g
from ..operators import cluster, raster, relational, spatial_join
from .base import COUNTRIES, PIXELS, SITES, TARGETS, Registry, countries, pixels, r4, sites, table, targets

query = Registry()
_EPSG = "(case when y >= 0 then 32600 else 32700 end + least(cast(floor((x + 180) / 6) as int) + 1, 60))"
_TEPSG = _EPSG.replace("y >=", "ty >=").replace("(x +", "(tx +")
_DIST = "sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))"


@query(f"select pid, case when pid % 6 = 0 then null else x end x, pid % 6 <> 0 as valid from {SITES}")
def c4_valid_geometry_flag(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d).withColumn("x", F.when(F.col("pid") % 6 != 0, F.col("x")))
    return s.select("pid", "x", F.col("x").isNotNull().alias("valid"))


@query(f"select pid, round(case when pid % 4 = 0 then x + 1 when pid % 4 = 1 and pid % 3 in (1, 2) then x when pid % 4 = 1 then pid % 3 else x end, 4) cx, pid % 5 = 0 as high from {SITES}")
def c8_c9_position_precedence(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pid")
    s = sites(spark, d).withColumn("best", F.when(p % 4 == 0, F.col("x") + 1)).withColumn("neigh", F.when(p % 4 == 1, (p % 3).cast("double")))
    kept = F.when(F.col("neigh").isin(1.0, 2.0), F.col("x")).otherwise(F.col("neigh"))  # 1 and 2 mark a new site at its own place
    return s.select("pid", r4(F.coalesce("best", kept, "x")).alias("cx"), (p % 5 == 0).alias("high"))


@query(f"select s.pid sid, best.tid tid, round(best.dist, 4) dist from {SITES} s left join (select s.pid, min(struct_pack(dist := {_DIST}, tid := t.tid)) best from (select *, {_EPSG} epsg from {SITES}) s join (select *, {_TEPSG} epsg from {TARGETS}) t on s.epsg = t.epsg and {_DIST} < 5 group by 1) b on s.pid = b.pid")
def d11_nearest_within_zone(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d).selectExpr("pid sid", "x sx", "y sy").withColumn("epsg", g.utm_epsg(F.col("sx"), F.col("sy")))
    t = targets(spark, d).withColumn("epsg", g.utm_epsg(F.col("tx"), F.col("ty")))
    return spatial_join.nearest_within(s, t, 5.0, ["epsg"]).withColumn("dist", r4("dist"))


@query(f"select country, count(*)::bigint n, sum(value) as value from {PIXELS} p where not exists (select 1 from {SITES} s where p.x >= s.x - 3 and p.x < s.x + 3 and p.y >= s.y - 3 and p.y < s.y + 3) group by 1")
def k2_masked_pixels(spark: SparkSession, d: str) -> DataFrame:
    b = sites(spark, d).selectExpr("pid bid", "x - 3D minx", "y - 3D miny", "x + 3D maxx", "y + 3D maxy")
    free = spatial_join.points_in_boxes(pixels(spark, d), b, 6.0, how="left_anti")
    return free.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("select id, basin, len from (select *, row_number() over (partition by id order by len desc, basin) r from (select o_custkey id, o_orderkey % 7 basin, round(sum(o_totalprice), 2) len from orders group by 1, 2)) where r = 1")
def f5_longest_overlap_winner(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 7).alias("basin")).agg(F.round(F.sum("o_totalprice"), 2).alias("len"))
    w = Window.partitionBy("id").orderBy(F.desc("len"), "basin")
    return o.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "basin", "len")


@query("select p_partkey, greatest(cast(floor(p_size * 40 / (250.0::double / pow(2, least(greatest(ceil(log2(250.0::double / greatest(p_size * 40, 1e-9))), 0), 1)))) as int), 1) steps from part")
def l3_adaptive_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fx.adaptive_count(F.col("p_size") * 40.0, 250.0, 100.0).alias("steps"))


@query(f"select pid, round((x - min(x) over w) / (max(x) over w - min(x) over w), 6) nx, round((y - min(y) over w) / (max(y) over w - min(y) over w), 6) ny from {SITES} window w as (partition by country)")
def l4_normalised_plane(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("country")
    n = lambda c: r4(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), 6)
    return sites(spark, d).select("pid", n("x").alias("nx"), n("y").alias("ny"))


@query("select p_partkey, round(p_size * 0.5, 4) back, case when p_size / 10.0 >= 1 then 250 else 0 end radius from part")
def m2_m3_ratio_and_radius(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", r4(s * 0.5).alias("back"), F.when(s / 10.0 >= 1, 250).otherwise(0).alias("radius"))


@query(f"select country, s_n, t_n, round(case when s_n + t_n <> 0 then (s_n - t_n) / (s_n + t_n)::double end, 6) ndi from (select s.country, count(distinct s.pid)::bigint s_n, count(distinct t.tid)::bigint t_n from {SITES} s left join {TARGETS} t on s.country = t.country group by 1)")
def n6_compare_by_country(spark: SparkSession, d: str) -> DataFrame:
    a = sites(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("s_n"))
    b = targets(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("t_n"))
    j = a.join(b, "country", "left").withColumn("t_n", F.coalesce("t_n", F.lit(0)))
    return j.select("country", "s_n", "t_n", F.round(fx.ndi(F.col("s_n").cast("double"), F.col("t_n").cast("double")), 6).alias("ndi"))


@query(f"select t.tid, best.pid, round(best.dist, 4) dist, round(best.pop, 2) pop, round(case when 1000 <> 0 then (best.pop - 1000) / 1000.0::double + 1 end, 6) multiple from {TARGETS} t join (select t.tid, min(struct_pack(dist := {_DIST}, pid := s.pid, pop := s.pop)) best from {TARGETS} t join {SITES} s on {_DIST} < 8 group by 1) b on t.tid = b.tid")
def n7_nearest_reference_plant(spark: SparkSession, d: str) -> DataFrame:
    t = targets(spark, d).selectExpr("tid sid", "tx sx", "ty sy")
    near = spatial_join.nearest_within(t, sites(spark, d).selectExpr("pid tid", "x tx", "y ty"), 8.0).where("tid is not null")
    j = near.selectExpr("sid tid", "tid pid", "dist").join(sites(spark, d).select("pid", "pop"), "pid")
    return j.select("tid", "pid", r4("dist").alias("dist"), F.round("pop", 2).alias("pop"), F.round(fx.multiple(F.col("pop"), F.lit(1000.0)), 6).alias("multiple"))


@query(f"""with u as (select pid, x, y from {SITES} union all select 100000 + tid, tx, ty from {TARGETS} t where not exists (select 1 from {SITES} s where {_DIST} <= 3)),
    e as (with recursive e as (select a.pid a, b.pid b from u a join u b on sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.5), r(pid, other) as (select a, b from e union select r.pid, e.b from r join e on r.other = e.a) select pid, min(other) as cluster from r group by 1) select pid, cluster from e""")
def n8_site_merge(spark: SparkSession, d: str) -> DataFrame:
    own = sites(spark, d)
    new = spatial_join.unmatched_targets(own.selectExpr("pid sid", "x sx", "y sy"), targets(spark, d), 3.0).selectExpr("100000 + tid pid", "tx x", "ty y")
    every = relational.union_all_by_name([own.select("pid", "x", "y"), new])
    return cluster.radius_clusters(every, 1.5).select("pid", "cluster")


@query(f"""select tile, round(sum(value), 2) as risk, count(*)::bigint n from (select p.value, cast(least(greatest(floor((p.x + 180.0) / 360.0 * 64), 0), 63) as int) || '-' || cast(least(greatest(floor((1.0 - asinh(tan(radians(p.y))) / pi()) / 2.0 * 64), 0), 63) as int) || '-6' tile from {PIXELS} p
    where exists (select 1 from {SITES} s where p.x >= s.x - 2 and p.x < s.x + 2 and p.y >= s.y - 2 and p.y < s.y + 2)) group by 1""")
def n_tile_risk(spark: SparkSession, d: str) -> DataFrame:
    b = sites(spark, d).selectExpr("pid bid", "x - 2D minx", "y - 2D miny", "x + 2D maxx", "y + 2D maxy")
    hit = spatial_join.points_in_boxes(pixels(spark, d), b, 4.0, how="left_semi")
    tile = F.concat_ws("-", g.tile_x(F.col("x"), 6).cast("string"), g.tile_y(F.col("y"), 6).cast("string"), F.lit("6"))
    return hit.groupBy(tile.alias("tile")).agg(F.round(F.sum("value"), 2).alias("risk"), F.count(F.lit(1)).alias("n"))


@query(f"""select pid, bid, {_EPSG}::int epsg from (select *, row_number() over (partition by k order by pid) r from (select pid, x, y, case when pid % 9 = 0 then null else pid % 700 end k from {SITES})) left join {COUNTRIES} on x >= minx and x < maxx where r = 1 or k is null""")
def l14_prepared_sites(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d).withColumn("k", F.when(F.col("pid") % 9 != 0, F.col("pid") % 700))
    s = relational.drop_duplicates_keep_null(s, "k", ["pid"]).select("pid", "x", "y")
    placed = spatial_join.points_in_boxes(s, countries(spark, d), 7.0, how="left")
    return placed.select("pid", "bid", g.utm_epsg(F.col("x"), F.col("y")).alias("epsg"))


@query("select p_brand, round(100.0 * count(*) / sum(count(*)) over (), 4) share from part group by 1")
def e25_category_shares(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(total), F.lit(True)).select("p_brand", r4(F.lit(100.0) * F.col("n") / F.col("total")).alias("share"))  # total: one row


@query(f"select country, sum(case when v > 0 then 1 else 0 end)::bigint populated, count(*)::bigint n from (select country, case when value > 20 then 1 else 0 end v from {PIXELS}) group by 1")
def k1_populated_by_country(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d).withColumn("v", raster.binarised(F.col("value") - 20.0))
    return p.groupBy("country").agg(F.sum("v").cast("long").alias("populated"), F.count(F.lit(1)).alias("n"))
