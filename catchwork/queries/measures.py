"""Aggregations, comparison measures, histograms and map aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..operators import relational as ops
from .base import SITES, Registry, lat, r4, sites, sql_lat, table

query = Registry()


@query("""select c_nationkey, round(sum(case when ind then c_acctbal end), 6) ind_sum, round(avg(case when ind then c_acctbal end), 6) ind_mean, round(median(case when ind then c_acctbal end), 6) ind_median, round(stddev_samp(case when ind then c_acctbal end), 6) ind_std,
    round(sum(case when not ind then c_acctbal end), 6) res_sum, round(avg(case when not ind then c_acctbal end), 6) res_mean, round(median(case when not ind then c_acctbal end), 6) res_median, round(stddev_samp(case when not ind then c_acctbal end), 6) res_std
    from (select *, c_mktsegment = 'MACHINERY' ind from customer) group by 1 having count(case when not ind then 1 end) > 0""")
def e6_country_measures(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("ind", F.col("c_mktsegment") == "MACHINERY")
    m = ops.country_measures(c, "c_nationkey", "c_acctbal", "ind").drop("res_n")
    return m.select("c_nationkey", *[r4(x, 6).alias(x) for x in m.columns if x != "c_nationkey"])


@query("select l_partkey % 97 as tile, year(l_shipdate)::int as year, round(sum(l_quantity), 2) zonal_sum from lineitem group by 1, 2")
def e7_tile_sums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 97).alias("tile"), F.year("l_shipdate").alias("year")).agg(F.round(F.sum("l_quantity"), 2).alias("zonal_sum"))


@query("select c_nationkey, list_sort(list(c_custkey) filter (where c_custkey % 5 = 0)) is null as none, coalesce(array_to_string(list_sort(list(c_custkey) filter (where c_custkey % 5 = 0)), ','), '') ids from customer group by 1")
def e4_collect_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_sort(F.collect_list(F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey"))))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(ids.alias("l")).select("c_nationkey", (F.size("l") == 0).alias("none"), F.array_join("l", ",").alias("ids"))


@query(f"select round(min(x), 4) minx, round(min(y), 4) miny, round(max(x), 4) maxx, round(max(y), 4) maxy from {SITES}")
def e12_total_bounds(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).agg(*[r4(f(c)).alias(n) for n, f, c in (("minx", F.min, "x"), ("miny", F.min, "y"), ("maxx", F.max, "x"), ("maxy", F.max, "y"))])


@query("select p_brand, max(n) filter (where r = 1) as n, max(p_size) filter (where r = 1) p_size from (select *, row_number() over (partition by p_brand order by n desc, p_size) r from (select p_brand, p_size, count(*)::bigint n from part group by 1, 2)) group by 1")
def e13_mode(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("p_brand").agg(F.max(F.struct("n", -F.col("p_size"))).alias("m")).select("p_brand", F.col("m.n").alias("n"), (-F.col("m.col2")).alias("p_size"))


@query("select c_mktsegment, round(avg(c_acctbal), 4) mean, round(median(c_acctbal), 4) median, round(stddev_samp(c_acctbal), 4) std from customer group by 1")
def e14_mean_median_std(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(r4(F.avg(v)).alias("mean"), r4(F.median(v)).alias("median"), r4(F.stddev_samp(v)).alias("std"))


@query("""with b as (select quantile_cont(o_totalprice, 0.01) lo, quantile_cont(o_totalprice, 0.99) hi from orders), i as (select * from orders, b where o_totalprice between lo and hi),
    m as (select count(*)::bigint total, round(avg(o_totalprice), 4) mean, round(median(o_totalprice), 4) median from i)
    select least(cast(floor((o_totalprice - lo) / (hi - lo) * 100) as int), 99) bin, count(*)::bigint n, any_value(total) total, any_value(mean) mean, any_value(median) median from i, m group by 1""")
def e15_trimmed_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = ops.trimmed_histogram(table(spark, d, "orders"), "o_totalprice", 0.01, 0.99)
    return h.select("bin", "n", "total", r4("mean").alias("mean"), r4("median").alias("median"))


@query("select o_orderpriority, round(quantile_cont(o_totalprice, 0.01), 4) p1, round(quantile_cont(o_totalprice, 0.99), 4) p99 from orders group by 1")
def e16_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = lambda q: r4(F.percentile("o_totalprice", q))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(p(0.01).alias("p1"), p(0.99).alias("p99"))


@query("select c_custkey, (case when c_custkey % 2 = 0 then 1 else 0 end + case when c_custkey % 3 = 0 then 1 else 0 end)::int as nulls, round(coalesce(case when c_custkey % 2 <> 0 then c_acctbal end, 0) + coalesce(case when c_custkey % 3 <> 0 then c_acctbal end, 0), 4) total from customer")
def e17_row_nulls_and_sums(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    c = table(spark, d, "customer").select("c_custkey", F.when(k % 2 != 0, v).alias("a"), F.when(k % 3 != 0, v).alias("b"))
    nulls = sum((F.col(x).isNull().cast("int") for x in ("a", "b")), F.lit(0))
    return c.select("c_custkey", nulls.alias("nulls"), r4(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("total"))


@query("select s_nationkey, arg_max(s_suppkey, s_acctbal) best, arg_min(s_suppkey, s_acctbal) worst from supplier group by 1")
def e18_arg_max_min(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max_by("s_suppkey", "s_acctbal").alias("best"), F.min_by("s_suppkey", "s_acctbal").alias("worst"))


@query("select distinct p_brand, p_size from part")
def e19_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", "p_size").distinct()


@query(f"select cast(floor((x + 180) / 10) as bigint) tx, cast(floor((y + 60) / 10) as bigint) ty, round(sum(pop), 2) total, round(sum(pop * 0.4), 2) rounded, round(median(pop), 4) median, count(*)::bigint n from {SITES} group by 1, 2")
def e24_marker_clusters(spark: SparkSession, d: str) -> DataFrame:
    t = lambda c, o: F.floor((F.col(c) + o) / 10)
    return sites(spark, d).groupBy(t("x", 180).alias("tx"), t("y", 60).alias("ty")).agg(F.round(F.sum("pop"), 2).alias("total"), F.round(F.sum(F.col("pop") * 0.4), 2).alias("rounded"), r4(F.median("pop")).alias("median"), F.count(F.lit(1)).alias("n"))


@query("select min(a)::double lo, round((min(a) + max(a)) / 2, 4) mid, max(a)::double hi from (select distinct round(p_retailprice, 1) a from part)")
def e26_legend_scale(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").select(F.round("p_retailprice", 1).alias("a")).distinct()
    return v.agg(F.min("a").alias("lo"), r4((F.min("a") + F.max("a")) / 2).alias("mid"), F.max("a").alias("hi"))


@query("select p_partkey, round((60 / 86.4::double) * p_size / (coalesce(nullif(q, 0), 0.269) * 1000) / 0.5, 8) ratio from (select *, case when p_partkey % 5 = 0 then 0 when p_partkey % 7 = 0 then null else p_retailprice / 100::double end q from part)")
def m1_load_ratio(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").withColumn("q", F.when(k % 5 == 0, 0.0).when(k % 7 != 0, F.col("p_retailprice") / 100.0))
    return p.select("p_partkey", F.round(fx.load_ratio(F.col("p_size"), F.col("q"), 0.5), 8).alias("ratio"))


@query(f"select p_partkey, round(0.23 * pow(1.047::double, 28 * cos(radians(abs({sql_lat('p_partkey')}))) - 20), 8) k from part")
def m4_decay_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(fx.decay_rate(lat("p_partkey")), 8).alias("k"))


@query(f"""select p_partkey, e / 0.5 >= 1 alive, round(case when e / 0.5 >= 1 then e * 0.5 else 0 end, 8) outflow from (select p_partkey, p_size / 10.0::double * exp(-(0.23 * pow(1.047::double, 28 * cos(radians(abs({sql_lat('p_partkey')}))) - 20)) *
    (case when ceil(p_size * 40 / 100.0::double) >= 2 then (ceil(p_size * 40 / 100.0::double) - 1) * 100 else p_size * 40 end) / 86400) e from part)""")
def m5_segment_plume(spark: SparkSession, d: str) -> DataFrame:
    alive, out = fx.plume(F.col("p_size") / 10.0, F.col("p_size") * 40.0, lat("p_partkey"), 0.5)
    return table(spark, d, "part").select("p_partkey", alive.alias("alive"), F.round(out, 8).alias("outflow"))


@query("select c_custkey, round(case when a + b <> 0 then (a - b) / (a + b) end, 6) ndi, round(case when b <> 0 then (a - b) / b + 1 end, 6) multiple from (select c_custkey, c_acctbal a, cast(c_custkey % 50 as double) b from customer)")
def m7_ndi_multiple(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("c_acctbal"), (F.col("c_custkey") % 50).cast("double")
    return table(spark, d, "customer").select("c_custkey", F.round(fx.ndi(a, b), 6).alias("ndi"), F.round(fx.multiple(a, b), 6).alias("multiple"))


@query("select p_partkey, round(5 + 20 * (ln(1 + p_size) - ln(2.0::double)) / (ln(51.0::double) - ln(2.0::double)), 6) log_size, round(5 + 20 * (p_size - 1) / 49.0::double, 6) linear_size from part")
def m17_size_scales(spark: SparkSession, d: str) -> DataFrame:
    v, a, b = F.col("p_size"), F.lit(1.0), F.lit(50.0)
    return table(spark, d, "part").select("p_partkey", F.round(fx.size_scale(v, a, b, 5, 25, True), 6).alias("log_size"), F.round(fx.size_scale(v, a, b, 5, 25), 6).alias("linear_size"))
