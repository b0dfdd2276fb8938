"""String, array, map and JSON scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .base import Registry, table

query = Registry()


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def m18_json_access(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", tx.or_default(m, F.lit("k"), F.lit(None).cast("string")).try_cast("bigint").alias("k"))


@query("select page_id, try_cast(nullif(regexp_extract(regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', ''), '([0-9]+)$', 1), '') as bigint) idx from pages")
def m10_trailing_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.trailing_index(F.col("url")).alias("idx"))


@query("select s_suppkey, cast(split_part(s_suppkey || '.png', '.', 1) as bigint) idx from supplier")
def m11_leading_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", tx.leading_index(F.concat(F.col("s_suppkey").cast("string"), F.lit(".png"))).alias("idx"))


_ANSWER = "case when c_custkey % 5 = 0 then 'no separator' when c_custkey % 5 = 1 then '[x].[y]: [z]' when c_custkey % 5 = 2 then (c_custkey % 9) || '.: why' when c_custkey % 5 = 3 then (c_custkey % 9) || '.Urban ' || c_mktsegment || ': near houses: yes' end"


@query(f"""select c_custkey, case when ok then try_cast(nullif(trim(split_part(split_part(t, ':', 1), '.', 1)), '') as int) end as number, case when ok then nullif(trim(substr(split_part(t, ':', 1), strpos(split_part(t, ':', 1), '.') + 1)), '') end as name,
    case when ok then nullif(trim(substr(t, strpos(t, ':') + 1)), '') end as why from (select c_custkey, {_ANSWER} t, coalesce(({_ANSWER}) like '%:%' and ({_ANSWER}) not like '[%', false) ok from customer)""")
def m9_model_answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    n = (k % 9).cast("string")
    t = F.when(k % 5 == 0, "no separator").when(k % 5 == 1, "[x].[y]: [z]").when(k % 5 == 2, F.concat(n, F.lit(".: why"))).when(k % 5 == 3, F.concat(n, F.lit(".Urban "), "c_mktsegment", F.lit(": near houses: yes")))
    number, name, why = tx.model_answer(F.col("t"))
    return table(spark, d, "customer").select("c_custkey", t.alias("t")).select("c_custkey", number.alias("number"), name.alias("name"), why.alias("why"))


@query("select p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) first, case when p_partkey % 2 = 0 then 'a' || p_size else 'b' end approach from part")
def m8_m12_patterns(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x_appr_a"), "p_size", F.lit("_v.gpkg"))).otherwise(F.lit("x_appr_b_v.gpkg"))
    return p.select("p_partkey", tx.first_match(F.col("p_brand"), ["zzz([0-9]+)", "([0-9]+)"]).alias("first"), tx.approach(name).alias("approach"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then null else substr(trim(o_orderkey::varchar), 1, 1) end region from orders")
def m13_region_code(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("o_orderkey") % 3 == 0, F.lit("nan")).otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", tx.region_code(k).alias("region"))


@query("select p_partkey, concat_ws(', ', p_brand, case when p_partkey % 2 = 0 then p_type end) label from part")
def m14_tag_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.tag_label(F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))).alias("label"))


@query("select p_partkey, regexp_replace(trim(p_type || ' / ' || p_brand), '[^A-Za-z0-9._-]+', '_', 'g') folder from part")
def m15_folder_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.folder_name(F.concat("p_type", F.lit(" / "), "p_brand")).alias("folder"))


@query("select p_partkey, round(p_size + case when p_partkey % 2 = 0 then 0 else 25.5::double end, 4) total, round(pi() * (p_size / 2.0::double) * (p_size / 2.0::double) + pi() * 0.2 * 0.2, 4) area from part")
def m16_l1_bracket_lists(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("["), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit(" None]")).otherwise(F.lit(" 25.5]")))
    c = F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", .4]"))
    return table(spark, d, "part").select("p_partkey", F.round(tx.bracket_sum(t), 4).alias("total"), F.round(tx.circle_area(c), 4).alias("area"))


@query("select c_custkey, case when c_custkey % 4 = 0 then null else cast(cast(round_even(c_custkey / 2.0::double, 0) as bigint) as varchar) end k from customer")
def c15_rounded_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("c_custkey") % 4 == 0, F.lit("n/a")).otherwise((F.col("c_custkey") / 2.0).cast("string"))
    return table(spark, d, "customer").select("c_custkey", tx.rounded_key(t).alias("k"))


@query("select c_custkey, c_custkey % 3 = 0 as flag from customer")
def c13_parse_bool(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    t = F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit(" Yes")).otherwise(F.lit("TRUE"))).otherwise(F.lit("n"))
    return table(spark, d, "customer").select("c_custkey", tx.parse_bool(t).alias("flag"))


@query("select o_orderkey, year(o_orderdate)::int + 10 as year from orders")
def a20_year_tokens(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/20_x/abc_pop_"), (F.year("o_orderdate") + 10).cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit("_2031.tif"))
    return table(spark, d, "orders").select("o_orderkey", tx.year_token(path).alias("year"))


@query("select n_nationkey, y as year, 'https://host.invalid/' || lower(n_name) || '_' || y || '.tif' as url from nation, generate_series(2015, 2025) t(y)")
def a14_url_catalogue(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("year", F.explode(F.sequence(F.lit(2015).cast("long"), F.lit(2025).cast("long"))))
    return n.select("n_nationkey", "year", F.format_string("https://host.invalid/%s_%d.tif", F.lower("n_name"), "year").alias("url"))


@query("select conv_id, count(*)::bigint turns, max(length(text))::bigint longest from conversations group by 1")
def a3_conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max(F.length("text")).cast("long").alias("longest"))
