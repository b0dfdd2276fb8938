"""Relational operators: null-preserving dedup, sharding, stratified samples, schema unions, resume filters, country shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import checkpointed


def drop_duplicates_keep_null(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of each non-null key by ``order``; every row with a null key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    known = df.where(F.col(key).isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return known.unionByName(df.where(F.col(key).isNull()))


def dense_ids(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Dense, reproducible row numbers from 0 by a total order, without one task for all rows.

    Rows are range-partitioned and sorted; each partition's count gives the next one's offset (one number a partition). The
    placed rows are stored, so that counts and ids see the same partitions.
    """
    placed = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(k, 0)
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    own = F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_part"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn(name, own + inside).drop("_part")


def shard(df: DataFrame, key: str, index: int, total: int, seed: int = 0) -> DataFrame:
    """Rows of shard ``index`` of ``total``: disjoint, exhaustive and stable, by a seeded hash of the key."""
    if not 0 <= index < total:
        raise ValueError(f"shard {index} of {total}")
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(total)) == index)


def _dealt(key: str, seed: int = 0) -> Column:
    """A seeded digest of a key, the same on every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_sample(df: DataFrame, cls: str, key: str, n: int, seed: int = 0, classes: int | None = None) -> DataFrame:
    """floor(n / classes) rows of each class by a seeded digest's order, then others in that order up to n rows in all.

    ``key`` identifies a row. A task passes on no more rows of a class than are wanted, and the others are among the first 2 n of all.
    """
    k = classes or df.select(cls).distinct().count()
    if not k:
        return df.limit(0)
    drawn, order = df.withColumn("_draw", _dealt(key, seed)), ["_draw", key]
    rank = F.row_number().over(Window.partitionBy(cls).orderBy(*order))
    first = drawn.withColumn("_rank", rank).where(F.col("_rank") <= n // k).drop("_rank").withColumn("_late", F.lit(0))
    rest = drawn.orderBy(*order).limit(2 * n).join(first.select(key), key, "left_anti").withColumn("_late", F.lit(1))
    return first.unionByName(rest).orderBy("_late", *order).limit(n).drop("_late", "_draw")


def union_all_by_name(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL over lower-cased names, columns that a frame lacks are null; names that differ by case meet."""

    def lowered(df: DataFrame) -> DataFrame:
        seen: dict[str, list[str]] = {}
        for c in df.columns:
            seen.setdefault(c.lower(), []).append(c)
        return df.select(*[F.coalesce(*[F.col(f"`{x}`") for x in cs]).alias(low) for low, cs in seen.items()])

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(lowered, frames))


def resume(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work items that the progress table lacks."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def not_in_keep_null(column: Column, values: list[str]) -> Column:
    """NOT IN that keeps nulls."""
    return F.coalesce(~column.isin(values), F.lit(True))


def valid_groups(df: DataFrame, group: str, flag: Column, least: float = 0.8) -> DataFrame:
    """Adds ``single`` (the group's only row) and ``chosen`` (share of flagged rows at least ``least``); null groups are neither."""
    w = Window.partitionBy(group)
    known = F.col(group).isNotNull()
    single = known & (F.count(F.lit(1)).over(w) == 1)
    share = F.avg(F.coalesce(flag, F.lit(True)).cast("double")).over(w)
    return df.withColumn("single", single).withColumn("chosen", known & (share >= least))


def country_measures(df: DataFrame, country: str, value: str, industrial: str) -> DataFrame:
    """Sum, mean, median and deviation by country for the industrial and the other rows; countries without others are left out."""
    out = [F.count(F.when(~F.col(industrial), 1)).alias("res_n")]
    for name, own in (("ind", F.col(industrial)), ("res", ~F.col(industrial))):
        v = F.when(own, F.col(value))
        out += [F.sum(v).alias(f"{name}_sum"), F.avg(v).alias(f"{name}_mean"), F.median(v).alias(f"{name}_median"), F.stddev_samp(v).alias(f"{name}_std")]
    return df.where(F.col(country).isNotNull()).groupBy(country).agg(*out).where("res_n > 0")


def trimmed_histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 100) -> DataFrame:
    """(bin, n, lo, hi, total, mean, median): histogram of the values between two quantiles, with the subset's measures."""
    known = df.where(F.col(value).isNotNull())
    bounds = known.agg(F.percentile(value, low).alias("lo"), F.percentile(value, high).alias("hi"))
    inside = known.join(F.broadcast(bounds), F.col(value).between(F.col("lo"), F.col("hi")))  # bounds: one row
    measures = inside.agg(F.count(F.lit(1)).alias("total"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(place.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(measures), F.lit(True))  # measures: one row


def round_robin(df: DataFrame, key: str, endpoints: list[str]) -> DataFrame:
    """Each row's endpoint, dealt by a digest of its key."""
    urls = F.array(*[F.lit(u) for u in endpoints])
    number = F.conv(F.substring(_dealt(key), 1, 8), 16, 10).cast("long")
    return df.withColumn("endpoint", F.element_at(urls, (number % len(endpoints) + 1).cast("int")))
