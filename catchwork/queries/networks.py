"""River networks: levels, downstream paths, common nodes and propagated loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network
from .base import RIVERS, SITES, Registry, r4, rivers, sites

query = Registry()
_PATHS = f"(with recursive e as (select * from {RIVERS}), r(src, node, depth) as (select id, id, 0 from e union all select r.src, e.next_down, r.depth + 1 from r join e on r.node = e.id where e.next_down <> 0) select * from r)"


@query(f"select src as id, max(depth)::bigint as level, arg_max(node, depth) as outlet from {_PATHS} group by 1")
def j6_levels(spark: SparkSession, d: str) -> DataFrame:
    return network.levels(rivers(spark, d)).select("id", "level", "outlet")


@query(f"select src, node, depth::int depth from {_PATHS}")
def j3_downstream_closure(spark: SparkSession, d: str) -> DataFrame:
    r = rivers(spark, d)
    return network.closure(r, r.select(F.col("id").alias("src")), 1000).select("src", "node", "depth")


_MEMBERS = f"(select distinct poly, src from (select id // 64 poly, id src from {RIVERS} where id % 3 = 0 and id % 16 in (1, 2, 3, 4) union all select 100000 + id, id from {RIVERS} where id % 50 = 0 union all select 200000 + id % 16, id from {RIVERS} where id % 7 = 0))"


def _members(r: DataFrame) -> DataFrame:
    a = r.where("id % 3 = 0 and id % 16 in (1, 2, 3, 4)").selectExpr("id div 64 poly", "id src")
    return a.union(r.where("id % 50 = 0").selectExpr("100000 + id", "id")).union(r.where("id % 7 = 0").selectExpr("200000 + id % 16", "id")).distinct()


@query(f"""select m.poly, best.node node from (select distinct poly from {_MEMBERS}) m left join (select poly, min(struct_pack(far := far, node := node)) best from (select m.poly, p.node, count(distinct m.src) n, sum(p.depth) far from {_MEMBERS} m join {_PATHS} p on m.src = p.src group by 1, 2) x
    join (select poly, count(*) k from {_MEMBERS} group by 1) k using (poly) where n = k group by 1) b on m.poly = b.poly""")
def j4_j5_first_common_node(spark: SparkSession, d: str) -> DataFrame:
    r = rivers(spark, d)
    m = _members(r)
    return network.first_common(network.closure(r, m.select("src").distinct(), 1000), m)


@query(None)
def j7_downstream_loads(spark: SparkSession, d: str) -> DataFrame:
    r = rivers(spark, d).withColumn("pop", (F.col("id") % 97) * 1000.0)
    p = network.propagate(r, 0.05)
    return p.select("id", "level", r4("inflow", 6).alias("inflow"), r4("ratio", 6).alias("ratio"), "alive", r4("outflow", 6).alias("outflow"))


@query(f"select s.pid, r.id, round(r.q, 4) q from {SITES} s left join {RIVERS} r on s.pid = r.id")
def d15_river_attributes(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).join(rivers(spark, d), F.col("pid") == F.col("id"), "left").select("pid", "id", r4("q").alias("q"))
