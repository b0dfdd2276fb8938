"""Derived tables: how the driver's tables stand in for sites, regions, rivers, settlements and pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry(dict):
    """name -> (query, SQL); filled by the decorator."""

    def __call__(self, sql: str | None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            self[query.__name__] = (query, sql)
            return query

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon(key: str) -> Column:
    return ((F.col(key) * 7919) % 36000).cast("double") / 100.0 - 180.0


def lat(key: str) -> Column:
    return ((F.col(key) * 104729) % 12000).cast("double") / 100.0 - 60.0


def sql_lon(key: str) -> str:
    return f"(cast(({key} * 7919) % 36000 as double) / 100.0::double - 180.0::double)"


def sql_lat(key: str) -> str:
    return f"(cast(({key} * 104729) % 12000 as double) / 100.0::double - 60.0::double)"


def r4(c: Column | str, digits: int = 4) -> Column:
    """Rounded for comparison; -0 is 0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, x, y, pop, country, segment): customers as sites."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("pid"), lon("c_custkey").alias("x"), lat("c_custkey").alias("y"), F.greatest("c_acctbal", F.lit(0.0)).alias("pop"), F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("segment"))


SITES = f"(select c_custkey pid, {sql_lon('c_custkey')} x, {sql_lat('c_custkey')} y, greatest(c_acctbal, 0.0::double) pop, c_nationkey country, c_mktsegment segment from customer)"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, tx, ty, country): suppliers as targets."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("tid"), lon("s_suppkey").alias("tx"), lat("s_suppkey").alias("ty"), F.col("s_nationkey").alias("country"))


TARGETS = f"(select s_suppkey tid, {sql_lon('s_suppkey')} tx, {sql_lat('s_suppkey')} ty, s_nationkey country from supplier)"


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bid, name, minx, miny, maxx, maxy): nations as stripes of longitude."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("double")
    return n.select(F.col("n_nationkey").alias("bid"), F.col("n_name").alias("name"), (k * 14.0 - 180.0).alias("minx"), F.lit(-60.0).alias("miny"), (k * 14.0 - 166.0).alias("maxx"), F.lit(60.0).alias("maxy"))


COUNTRIES = "(select n_nationkey bid, n_name as name, cast(n_nationkey as double) * 14.0::double - 180.0::double minx, -60.0::double miny, cast(n_nationkey as double) * 14.0::double - 166.0::double maxx, 60.0::double maxy from nation)"


def rivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, next_down, main_riv, q, length, lat): parts as a forest of sixteen binary trees."""
    p = table(spark, sf_dir, "part")
    main, j = F.col("p_partkey") % 16, F.floor(F.col("p_partkey") / 16) + 1
    down = F.floor(j / 2)
    return p.select(F.col("p_partkey").alias("id"), F.when(down >= 1, (down - 1) * 16 + main).otherwise(F.lit(0)).alias("next_down"), main.alias("main_riv"), (F.col("p_retailprice") / 100.0).alias("q"), (F.col("p_size") * 40.0).alias("length"), lat("p_partkey").alias("lat")).where("id >= 1")


RIVERS = f"""(select * from (select p_partkey id, case when (p_partkey // 16 + 1) // 2 >= 1 then ((p_partkey // 16 + 1) // 2 - 1) * 16 + p_partkey % 16 else 0 end next_down, p_partkey % 16 main_riv, p_retailprice / 100.0::double q, p_size * 40.0::double length, {sql_lat('p_partkey')} lat from part) where id >= 1)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, row, col, value, country, x, y): line items as pixels of one degree."""
    i = table(spark, sf_dir, "lineitem").select(
        (((F.col("l_orderkey") * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("pid"), (F.col("l_partkey") % 120).cast("int").alias("row"), (F.col("l_orderkey") % 360).cast("int").alias("col"), (F.col("l_quantity") - 5.0).alias("value")
    )
    return i.withColumn("x", F.col("col") + F.lit(-179.5)).withColumn("y", F.lit(59.5) - F.col("row")).withColumn("country", F.floor(F.col("col") / 14).cast("int"))


PIXELS = "(select ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber pid, cast(l_partkey % 120 as int) as row, cast(l_orderkey % 360 as int) as col, l_quantity - 5.0::double as value, l_orderkey % 360 + -179.5::double x, 59.5::double - l_partkey % 120 y, cast((l_orderkey % 360) // 14 as int) country from lineitem)"
