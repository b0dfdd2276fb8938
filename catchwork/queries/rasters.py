"""Raster queries, and the flagship: served and unserved population by country."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster
from .base import PIXELS, SITES, Registry, pixels, r4, sites

query = Registry()
_BOXES = f"(select pid bid, cast(floor((x + 180) / 14) as int) country, x - 2.0::double minx, y - 2.0::double miny, x + 2.0::double maxx, y + 2.0::double maxy from {SITES})"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).selectExpr("pid bid", "cast(floor((x + 180D) / 14D) as int) country", "x - 2D minx", "y - 2D miny", "x + 2D maxx", "y + 2D maxy")


@query(f"""select country, sum(case when served then v else 0 end)::bigint served, sum(case when served then 0 else v end)::bigint unserved, sum(v)::bigint total, round(sum(case when served then v else 0 end) / (sum(v) + 0.1::double), 6) served_index from (select p.country, abs(cast(trunc(p.value) as bigint)) v,
    exists (select 1 from {_BOXES} b where b.country = p.country and p.x >= b.minx and p.x < b.maxx and p.y >= b.miny and p.y < b.maxy) served from {PIXELS} p) group by 1""")
def e10_e11_served_index(spark: SparkSession, d: str) -> DataFrame:
    t = raster.served_totals(pixels(spark, d), _boxes(spark, d), 4.0, ["country"])
    return t.select("country", "served", "unserved", "total", F.round("served_index", 6).alias("served_index"))


@query(f"select pid, case when value > 0 then 1 else 0 end as v from {PIXELS}")
def k1_binarise(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("pid", raster.binarised(F.col("value")).alias("v"))


@query(f"select row, col, round(sum(value), 2) as value from {PIXELS} where value <> 10 group by 1, 2 union all select row, col, null from {PIXELS} group by 1, 2 having count(*) filter (where value <> 10) = 0")
def e22_mosaic(spark: SparkSession, d: str) -> DataFrame:
    return raster.mosaic(pixels(spark, d), mark=10.0).select("row", "col", F.round("value", 2).alias("value"))


@query(f"select cast(floor(y / 3) as bigint) as row, cast(floor(x / 3) as bigint) as col, arg_max(value, struct_pack(a := pid, b := value)) as value from {PIXELS} group by 1, 2")
def e23_rasterise_last(spark: SparkSession, d: str) -> DataFrame:
    return raster.rasterised(pixels(spark, d), 3.0, F.struct("pid", "value")).select("row", "col", "value")


@query(f"select cast(floor(y / 3) as bigint) as row, cast(floor(x / 3) as bigint) as col, round(sum(value), 2) as value from {PIXELS} group by 1, 2")
def e23_rasterise_sum(spark: SparkSession, d: str) -> DataFrame:
    return raster.rasterised(pixels(spark, d), 3.0, "pid", "sum").select("row", "col", F.round("value", 2).alias("value"))


_LAND = f"(select row * 360 + col pid, row, col, max(value) as value, any_value(country) country from {PIXELS} group by row, col)"


def _land(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d).groupBy("row", "col").agg(F.max("value").alias("value"), F.first("country").alias("country"))
    return p.withColumn("pid", F.col("row") * 360 + F.col("col"))


def _islands_sql(near: str) -> str:
    """The least label spreads over neighbours until no pixel changes."""
    step = "select e.a, min(c.cluster) from c join e on e.b = c.pid join recurring.c r on r.pid = e.a where c.cluster < r.cluster group by e.a"
    return f"with recursive l as materialized (select * from {_LAND}), e as materialized (select a.pid a, b.pid b from l a join l b on a.country = b.country and b.row between a.row - 1 and a.row + 1 and {near}), c(pid, cluster) using key (pid) as (select pid, pid from l union {step})"


@query(_islands_sql("abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1") + " select pid, cluster from c")
def k4_islands_eight(spark: SparkSession, d: str) -> DataFrame:
    return raster.islands(_land(spark, d), ["country"]).select("pid", "cluster")


@query(_islands_sql("abs(a.row - b.row) + abs(a.col - b.col) <= 1") + " select pid, cluster from c")
def k4_islands_four(spark: SparkSession, d: str) -> DataFrame:
    return raster.islands(_land(spark, d), ["country"], corners=False).select("pid", "cluster")


@query(_islands_sql("abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1") + " select cluster, count(*)::bigint pixel_count, sum(cast(trunc(value) as bigint))::bigint pop_sum from c join l on c.pid = l.pid group by 1 having count(*) >= 2 and sum(cast(trunc(value) as bigint)) > 0")
def k6_c7_large_islands(spark: SparkSession, d: str) -> DataFrame:
    return raster.large_islands(_land(spark, d), ["country"], 2).select("cluster", "pixel_count", "pop_sum")


_W, _H = "least(p.x + 0.5, b.maxx) - greatest(p.x - 0.5, b.minx)", "least(p.y + 0.5, b.maxy) - greatest(p.y - 0.5, b.miny)"


@query(f"""select bid, round(sum(f * v), 4) as sum, round(sum(f), 4) as count, round(sum(f * v) / sum(f), 4) as mean, round(sqrt(greatest(sum(f * v * v) / sum(f) - (sum(f * v) / sum(f)) * (sum(f * v) / sum(f)), 0)), 3) as std
    from (select b.bid, ({_W}) * ({_H}) f, greatest(p.value, 0) v from {PIXELS} p join {_BOXES} b on {_W} > 0 and {_H} > 0) group by 1""")
def e8_e9_zonal_statistics(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d).selectExpr("x - 0.5D minx", "y - 0.5D miny", "value")
    z = raster.zonal(p, _boxes(spark, d).drop("country"), 1.0, 4.0)
    return z.select("bid", r4("sum").alias("sum"), r4("count").alias("count"), r4("mean").alias("mean"), r4("std", 3).alias("std"))


@query(f"select r::bigint as row, c::bigint as col, value from (select distinct cast(floor((row + 0.5) / 2) as bigint) r, cast(floor((col + 0.5) / 2) as bigint) c from {_LAND}) n left join {_LAND} l on l.row = cast(floor((r + 0.5) * 2) as bigint) and l.col = cast(floor((c + 0.5) * 2) as bigint)")
def k8_resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    return raster.resampled(_land(spark, d), 2.0).select("row", "col", "value")
