"""Operators' decisions applied to whole documents: the rows that stay, with all their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import broadcast_if_small, checkpointed
from . import decontaminate, pii, quality, simhash

#: Documents with personal data that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Documents that the quality rules keep, rows that repeat one alike; null and empty texts fail. An empty table stays empty."""
    return quality.keep_good(docs, host)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate component: that of its smallest doc_id.

    Of rows that share this id in the component the one with the smallest text hash stays, of rows with the same id and text the
    first by all columns. Components that share an id stay apart. Null and wordless texts are one component. A
    component of null ids alone keeps one row as well. Clashing column names don't matter; an empty table stays empty.
    """
    found = simhash.grouped(docs).where(F.col("component_id").eqNullSafe(F.col("doc_id")))
    rows = found.groupBy("root", F.col("doc_id").alias("_first"), F.col("digest").alias("_digest")).agg(F.count(F.lit(1)).alias("_rows"))
    chosen = rows.groupBy("root", "_first").agg(F.min(F.struct("_digest", "_rows")).alias("_c")).select("_first", F.col("_c._digest").alias("_digest"), F.col("_c._rows").alias("_rows"))
    chosen = checkpointed(chosen)
    own, digest = docs.columns, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_first"]) & (digest == chosen["_digest"]))
    single = kept.where("_rows = 1").select(*own)
    if chosen.where("_rows > 1").isEmpty():
        return single
    first = F.min(F.struct(*[F.col(f"`{c}`") for c in own])).alias("_row")
    return single.unionByName(kept.where("_rows > 1").groupBy("_first", "_digest").agg(first).select("_row.*"))


def uncontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Documents without any hit of a benchmark window, rows that repeat one alike; null, empty and wordless texts have none and stay.

    Items that are null or wordless hit nothing. Very long texts are scanned whole. Columns whose names clash are kept as they are.
    """
    rows = docs.select(*[F.col(c).alias(f"_{c}") for c in docs.columns], F.struct(*docs.columns).alias("doc_id"), F.col("text"))
    clean = decontaminate.scan(rows.select("doc_id", "text"), bench).where(F.size("hits") == 0)
    return clean.select("doc_id.*")


def without_personal_data(docs: DataFrame) -> DataFrame:
    """All documents, their personal data replaced by its kind in brackets; n_chars, where there is one, is counted anew.

    Null texts stay null, empty ones empty; rows that repeat one are treated alike; texts of any length are processed whole. n_chars
    of other texts stays as it is. Other columns are kept, whatever their names.
    """
    found = pii.personal_data(docs).where(F.size("found") > 0).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.explode("found").alias("s"))
    spans = pii.merged(found.select("_id", "_digest", "s.start", "s.end", "s.kind").distinct())
    found = checkpointed(spans.groupBy("_id", "_digest").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_found")))
    found = broadcast_if_small(found, found.count(), BROADCAST_ROWS)
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["_digest"])
    out = docs.join(found, same, "left").withColumn("text", F.when(F.col("_found").isNull(), F.col("text")).otherwise(pii.redacted(F.col("text"), F.col("_found"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_found").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
