"""Clusters, merges, weights and weighted-Voronoi allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import ring_area
from ..operators import allocation, cluster, spatial_join
from .base import SITES, Registry, r4, sites

query = Registry()
_NEAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
#: Clusters as the transitive closure of pairs, for the SQL side.
CLUSTERS = f"""(with recursive p as (select * from {SITES}), e as (select a.pid a, b.pid b from p a join p b on {_NEAR} <= 1.2), r(pid, other) as (select a, b from e union select r.pid, e.b from r join e on r.other = e.a) select pid, min(other) as cluster from r group by 1)"""


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    return cluster.radius_clusters(sites(spark, d), 1.2)


@query(f"select pid, cluster from {CLUSTERS}")
def j1_radius_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clustered(spark, d).select("pid", "cluster")


@query(f"""with recursive q as (select pid, x - 1 minx, x + 1 maxx, y - 1 miny, y + 1 maxy, country from {SITES}), e as (select a.pid a, b.pid b from q a join q b on a.country = b.country and a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy),
    r(pid, other) as (select a, b from e union select r.pid, e.b from r join e on r.other = e.a) select pid as bid, min(other) as cluster from r group by 1""")
def j2_overlap_components(spark: SparkSession, d: str) -> DataFrame:
    b = sites(spark, d).selectExpr("pid bid", "country", "x - 1D minx", "x + 1D maxx", "y - 1D miny", "y + 1D maxy")
    return cluster.overlap_clusters(b, 2.0, ["country"]).select("bid", "cluster")


@query(f"""select cluster, arg_min(pid, nulls * 1000000 + pid) pid, round(sum(pop), 2) pop from (select c.cluster, s.pid, s.pop, (case when s.pid % 3 = 0 then 1 else 0 end) nulls from {CLUSTERS} c join {SITES} s on c.pid = s.pid) group by 1""")
def e1_cluster_merge_fullest(spark: SparkSession, d: str) -> DataFrame:
    c = _clustered(spark, d).withColumn("note", F.when(F.col("pid") % 3 != 0, F.lit("x"))).select("cluster", "pid", "note", "pop")
    return cluster.merge_fullest(c, "cluster", "pid", ["pop"]).select("cluster", "pid", F.round("pop", 2).alias("pop"))


@query(f"""select cluster, min(case when s.pid % 3 <> 0 then s.pid end) note, min(case when s.pid % 2 <> 0 then s.pid end) mark, round(sum(pop), 2) pop from {CLUSTERS} c join {SITES} s on c.pid = s.pid group by 1""")
def e2_cluster_merge_first_known(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pid")
    c = _clustered(spark, d).select("cluster", "pid", F.when(p % 3 != 0, p).alias("note"), F.when(p % 2 != 0, p).alias("mark"), "pop")
    return cluster.merge_first_known(c, "cluster", "pid", ["pop"]).select("cluster", "note", "mark", F.round("pop", 2).alias("pop"))


@query(f"""select cluster, 'plant' as label, round(min(x), 4) minx, round(min(y), 4) miny, round(max(x), 4) maxx, round(max(y), 4) maxy, count(*)::bigint n from {CLUSTERS} c join {SITES} s on c.pid = s.pid group by 1""")
def e20_cluster_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = cluster.cluster_boxes(_clustered(spark, d), "cluster", "plant")
    return b.select("cluster", "label", *[r4(c).alias(c) for c in ("minx", "miny", "maxx", "maxy")], "n")


@query(f"select round(avg(d), 4) as mean_nearest from (select a.pid, min({_NEAR}) d from {SITES} a join {SITES} b on a.pid <> b.pid group by 1)")
def e21_mean_nearest_distance(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d)
    near = spatial_join.nearest(s.selectExpr("pid sid", "x sx", "y sy"), s.selectExpr("pid tid", "x tx", "y ty"), other=True)
    return near.agg(r4(F.avg("dist")).alias("mean_nearest"))


def _weights_sql(shape: str) -> str:
    return f"""(with f as (select *, case when coalesce(pop, 0) = 0 then avg(pop) over (partition by country) else pop end filled from {SITES}),
      s as (select *, {shape} / sum({shape}) over (partition by country) share from f),
      m as (select *, median(share) over (partition by country) mid, stddev_samp(share) over (partition by country) dev from s),
      c as (select *, case when dev > 0 then least(greatest(share, mid / 10), mid + 3 * dev) else share end clipped from m)
      select *, clipped / sum(clipped) over (partition by country) weight from c)"""


@query(f"select pid, country, round(weight, 8) weight from {_weights_sql('sqrt(filled)')}")
def l2_weights_sqrt(spark: SparkSession, d: str) -> DataFrame:
    return allocation.with_weights(sites(spark, d), "pop", "country").select("pid", "country", F.round("weight", 8).alias("weight"))


@query(f"select pid, country, round(weight, 8) weight from {_weights_sql('ln(1 + filled)')}")
def l2_weights_log(spark: SparkSession, d: str) -> DataFrame:
    return allocation.with_weights(sites(spark, d), "pop", "country", "log").select("pid", "country", F.round("weight", 8).alias("weight"))


_GROUPS = f"(select country, count(*) n from {SITES} group by 1)"
_CELLS = f"(select country, i, j, 0.0::double + (i + 0.5::double) * 1.0::double x, 0.0::double + (j + 0.5::double) * 1.0::double y from {_GROUPS}, generate_series(0, 11) a(i), generate_series(0, 11) b(j))"


def _allocated(spark: SparkSession, d: str, metric: str) -> DataFrame:
    s = sites(spark, d).selectExpr("pid sid", "country", "cast((pid * 37) % 120 as double) / 10D sx", "cast((pid * 53) % 120 as double) / 10D sy", "1D + cast(pid % 5 as double) weight")
    box = s.select("country").distinct().selectExpr("country", "0D minx", "0D miny", "12D maxx", "12D maxy")
    return allocation.allocate(allocation.grid(box, "country", 1.0), s, "country", metric)


def _allocated_sql(score: str) -> str:
    own = "(select pid sid, country, cast((pid * 37) % 120 as double) / 10.0::double sx, cast((pid * 53) % 120 as double) / 10.0::double sy, 1.0::double + cast(pid % 5 as double) weight from " + SITES + ")"
    return f"(select country, i, j, min(struct_pack(d := {score}, sid := sid)).sid site from (select c.*, s.sid, s.weight, (c.x - s.sx) * (c.x - s.sx) + (c.y - s.sy) * (c.y - s.sy) d2 from {_CELLS} c join {own} s on c.country = s.country) group by 1, 2, 3)"


_MULT = "sqrt(d2) / weight"
_ADD = "sqrt(case when sqrt(d2) * sqrt(d2) - weight * weight < 0 then 0.01::double else sqrt(d2) * sqrt(d2) - weight * weight end)"


@query(f"select country, i::int i, j::int j, site from {_allocated_sql(_MULT)}")
def l7_voronoi_multiplicative(spark: SparkSession, d: str) -> DataFrame:
    return _allocated(spark, d, "multiplicative").select("country", "i", "j", "site")


@query(f"select country, i::int i, j::int j, site from {_allocated_sql(_ADD)}")
def l7_voronoi_additive(spark: SparkSession, d: str) -> DataFrame:
    return _allocated(spark, d, "additive").select("country", "i", "j", "site")


@query(f"select country, site, count(*)::bigint n_cells, count(*) * 1.0::double area from {_allocated_sql(_MULT)} group by 1, 2")
def l10_region_areas(spark: SparkSession, d: str) -> DataFrame:
    return allocation.regions(_allocated(spark, d, "multiplicative"), "country", 1.0).select("country", "site", "n_cells", "area")


@query(f"select country, site, count(*)::double area from {_allocated_sql(_MULT)} group by 1, 2")
def l9_region_outlines(spark: SparkSession, d: str) -> DataFrame:
    """What the outlines enclose, holes taken away, is what the cells cover."""
    rings = allocation.region_outlines(_allocated(spark, d, "multiplicative"), "country")
    enclosed = F.aggregate(F.transform("rings", ring_area), F.lit(0.0), lambda a, t: a + t)
    return rings.select("country", "site", enclosed.alias("area"))
