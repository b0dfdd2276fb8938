"""Radius and overlap clusters, and their merges into one record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from .spatial_join import overlapping_boxes, within_radius


def labelled(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``cluster``: the smallest node reachable over the edges (a, b); single nodes are their own."""
    roots = connected_components(edges).withColumnRenamed("node", "_node")
    return nodes.join(roots, F.col(node) == F.col("_node"), "left").withColumn("cluster", F.coalesce("root", node)).drop("_node", "root")


def radius_clusters(points: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Points (pid, x, y) with the cluster of the transitive closure of ``distance <= radius`` among equal ``keys``."""
    keys = keys or []
    pairs = within_radius(points.selectExpr("pid sid", "x sx", "y sy", *keys), points.selectExpr("pid tid", "x tx", "y ty", *keys), radius, keys, closed=True)
    return labelled(points, "pid", pairs.where("sid < tid").selectExpr("sid a", "tid b"))


def overlap_clusters(boxes: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """Boxes with the component of overlapping (or touching) boxes."""
    return labelled(boxes, "bid", overlapping_boxes(boxes, size, keys))


def merge_fullest(df: DataFrame, cluster: str, order: str, summed: list[str]) -> DataFrame:
    """One row a cluster: the row with the fewest nulls (ties: the first by ``order``), with ``summed`` columns added up."""
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    rest = [c for c in df.columns if c != cluster and c not in summed]
    best = F.min_by(F.struct(*rest), F.struct(nulls, F.col(order)))
    return df.groupBy(cluster).agg(best.alias("_best"), *[F.sum(c).alias(c) for c in summed]).select(cluster, "_best.*", *summed)


def merge_first_known(df: DataFrame, cluster: str, order: str, summed: list[str]) -> DataFrame:
    """One row a cluster: of each column the first known value by ``order``, with ``summed`` columns added up."""
    rest = [c for c in df.columns if c != cluster and c not in summed]
    known = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    return df.groupBy(cluster).agg(*known, *[F.sum(c).alias(c) for c in summed])


def cluster_boxes(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Bounding box of each cluster with a label."""
    return df.groupBy(cluster).agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"), F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(label))
