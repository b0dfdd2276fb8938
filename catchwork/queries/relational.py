"""Projections, filters, equi-joins, windows, sorts, shards and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as ops
from .base import SITES, Registry, r4, sites, table

query = Registry()


@query(f"select country, pid, round(pop, 4) pop, segment from {SITES} where pop > 1000")
def c1_project_filter(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).where("pop > 1000").select("country", "pid", r4("pop").alias("pop"), "segment")


@query("select s_suppkey as k, s_nationkey as ind_nation, round(s_acctbal, 4) as ind_balance from supplier")
def c2_prefix_rename(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), r4("s_acctbal").alias("balance"))
    return s.withColumnsRenamed({c: f"ind_{c}" for c in s.columns if c != "k"})


@query("select * replace (upper(n_name) as n_name) from nation")
def c3_replace_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").withColumn("n_name", F.upper("n_name"))


@query("select o_orderkey, case when o_orderkey % 7 = 0 then null else o_orderpriority end as category from orders where o_orderkey % 7 = 0 or o_orderpriority not in ('1-URGENT', '2-HIGH')")
def c6_not_in_keeps_null(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("category", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    return o.where(ops.not_in_keep_null(F.col("category"), ["1-URGENT", "2-HIGH"])).select("o_orderkey", "category")


@query("select c_custkey, coalesce(case when c_custkey % 3 = 0 then null else c_mktsegment end, case when c_custkey % 6 = 0 then null else 'alt' end, 'XX') as iso from customer")
def c10_null_default_chain(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    return c.select("c_custkey", F.coalesce(F.when(k % 3 != 0, F.col("c_mktsegment")), F.when(k % 6 != 0, F.lit("alt")), F.lit("XX")).alias("iso"))


@query("select event_id from events where event_id not in (select event_id from events where event_type = 'click' or event_id % 5 = 0)")
def c11_resume_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return ops.resume(e, e.where("event_type = 'click' or event_id % 5 = 0"), "event_id").select("event_id")


@query("select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as idx from orders")
def c12_dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return ops.dense_ids(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "idx")


@query("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def d14_inner_joins(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("select c_custkey, o_orderkey from customer left join (select * from orders where o_orderstatus = 'P') on c_custkey = o_custkey")
def d13_left_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""select n_nationkey, cs, ss from nation
    left join (select c_nationkey, count(*)::bigint cs from customer group by 1) on n_nationkey = c_nationkey
    left join (select s_nationkey, count(*)::bigint ss from supplier group by 1) on n_nationkey = s_nationkey""")
def d16_chained_left_joins(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "nation")
    for t, k, name in (("customer", "c_nationkey", "cs"), ("supplier", "s_nationkey", "ss")):
        sums = table(spark, d, t).groupBy(F.col(k).alias(f"_{k}")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(sums, F.col("n_nationkey") == F.col(f"_{k}"), "left")
    return out.select("n_nationkey", "cs", "ss")


@query("""select coalesce(a.tile, b.tile) tile, a.s r250, b.s r500 from
    (select l_partkey % 50 tile, round(sum(l_quantity), 2) s from lineitem where l_partkey % 3 <> 0 and l_partkey % 50 < 40 group by 1) a full join
    (select l_partkey % 50 tile, round(sum(l_quantity), 2) s from lineitem where l_partkey % 3 <> 1 and l_partkey % 50 > 10 group by 1) b on a.tile = b.tile""")
def d17_full_outer_join(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").withColumn("tile", F.col("l_partkey") % 50)
    a = i.where("l_partkey % 3 <> 0 and tile < 40").groupBy("tile").agg(F.round(F.sum("l_quantity"), 2).alias("r250"))
    b = i.where("l_partkey % 3 <> 1 and tile > 10").groupBy("tile").agg(F.round(F.sum("l_quantity"), 2).alias("r500"))
    return a.join(b, "tile", "full")


@query("select s_suppkey, coalesce(n_name, 'none') as country from supplier left join (select * from nation where n_nationkey < 20) on s_nationkey = n_nationkey")
def d19_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("country"))


@query("select o.o_orderkey, coalesce(f.price, round(o.o_totalprice, 2)) as price from orders o left join (select o_orderkey k, round(o_totalprice * 2, 2) price from orders where o_orderstatus = 'F') f on o.o_orderkey = f.k")
def d20_conditional_column(spark: SparkSession, d: str) -> DataFrame:
    """A subset's values joined back on the key, as a conditional column: no join is needed."""
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.round(p * 2, 2)).otherwise(F.round(p, 2)).alias("price"))


@query("select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49)")
def d21_semi_join(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").where("l_quantity > 49")
    return table(spark, d, "part").join(i, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("select c_custkey from customer where c_custkey % 9 = 0 or not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O')")
def d22_anti_join_null_new(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("geo", F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey")))
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return c.join(o, F.col("geo") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""select c_custkey, basin is not null and n = 1 as single, basin is not null and share >= 0.8 as chosen from (select *, count(*) over (partition by basin) n,
    avg(case when c_acctbal > 0 then 1.0::double else 0.0::double end) over (partition by basin) share from (select *, case when c_custkey % 11 = 0 then null else c_custkey % 400 end basin from customer))""")
def f1_f2_valid_groups(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("basin", F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") % 400))
    return ops.valid_groups(c, "basin", F.col("c_acctbal") > 0).select("c_custkey", "single", "chosen")


@query("""select c_custkey, k from (select *, row_number() over (partition by k order by c_custkey) r from (select c_custkey, case when c_custkey % 4 = 0 then null else c_custkey % 100 end k from customer)) where r = 1 or k is null""")
def f3_dedup_keeps_null(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 100).alias("k"))
    return ops.drop_duplicates_keep_null(c, "k", ["c_custkey"])


@query("select o_custkey, o_orderstatus, min(o_orderkey) as o_orderkey from orders group by 1, 2")
def f4_multi_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""select country, arg_max(path, year) path, max(year) as year from (select o_custkey % 25 country, year(o_orderdate) * 1000000 + o_orderkey as year, 'r_' || o_orderkey as path from orders) group by 1""")
def f8_newest_per_country(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("country"), (F.year("o_orderdate") * 1000000 + F.col("o_orderkey")).alias("year"), F.concat(F.lit("r_"), F.col("o_orderkey")).alias("path"))
    return o.groupBy("country").agg(F.max_by("path", "year").alias("path"), F.max("year").alias("year"))


@query("""select c_custkey, c_mktsegment from (select *, row_number() over (partition by c_mktsegment order by h, c_custkey) r from (select *, md5('42|' || c_custkey) h from customer))
    order by r > 200 // (select count(distinct c_mktsegment) from customer), h, c_custkey limit 200""")
def f7_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return ops.stratified_sample(table(spark, d, "customer"), "c_mktsegment", "c_custkey", 200, seed=42).select("c_custkey", "c_mktsegment")


@query("select p_partkey, p_brand, p_size from part order by p_size desc, p_brand, p_partkey limit 100")
def g1_sort_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy(F.desc("p_size"), "p_brand", "p_partkey").limit(100).select("p_partkey", "p_brand", "p_size")


@query("select o_orderkey, 1::bigint shards from orders")
def g4_shards_partition(spark: SparkSession, d: str) -> DataFrame:
    """Every order is in one shard of four, and in no other."""
    o, out = table(spark, d, "orders"), None
    for i in range(4):
        s = ops.shard(o, "o_orderkey", i, 4, seed=7).select("o_orderkey", F.lit(i).alias("shard"))
        out = s if out is None else out.unionByName(s)
    return out.groupBy("o_orderkey").agg(F.count("shard").alias("shards"))


@query("select event_id, 'u' || (('0x' || md5('0|' || event_id)[1:8])::bigint % 3 + 1) as endpoint from events")
def g6_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return ops.round_robin(table(spark, d, "events"), "event_id", ["u1", "u2", "u3"]).select("event_id", "endpoint")


@query("""select s_suppkey as id, s_name as name, s_nationkey as nation, null::varchar as segment, 's' as grid from supplier
    union all select c_custkey, c_name, c_nationkey, c_mktsegment, 'c' from customer""")
def h1_h2_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ID"), F.col("s_name").alias("Name"), F.col("s_nationkey").alias("nation"), F.lit("s").alias("grid"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("NATION"), F.col("c_mktsegment").alias("segment"), F.lit("c").alias("grid"))
    return ops.union_all_by_name([s, c]).select("id", "name", "nation", "segment", "grid")


@query("""select 'union' as op, k from (select c_nationkey % 20 k from customer union select s_nationkey + 5 from supplier)
    union all select 'except', k from (select distinct c_nationkey k from customer except select s_nationkey + 5 from supplier)
    union all select 'intersect', k from (select c_nationkey k from customer intersect select s_nationkey + 5 from supplier)""")
def h4_set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier").select((F.col("s_nationkey") + 5).alias("k"))
    own = c.select(F.col("c_nationkey").alias("k"))
    sets = {"union": c.select((F.col("c_nationkey") % 20).alias("k")).union(s).distinct(), "except": own.subtract(s), "intersect": own.intersect(s)}
    out = None
    for name, v in sets.items():
        row = v.select(F.lit(name).alias("op"), "k")
        out = row if out is None else out.union(row)
    return out
