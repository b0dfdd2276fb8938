"""Point-in-polygon joins: covering cells from bounds, an equi-join on cells, and an exact Arrow-batched test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import utm_epsg
from .kernel import wkb_area, wkb_bounds, wkb_centroid, wkb_contains
from .spatial_join import points_in_boxes


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, keys: list[str] | None = None) -> DataFrame:
    """(pid, bid): every polygon (bid, geom as WKB) that holds a point (pid, x, y); equal ``keys`` are required.

    Ids and bounds meet in the cells; the geometries join the candidates by id afterwards, so that none is copied to its cells.
    """
    keys = keys or []
    boxed = polygons.select("bid", *keys, wkb_bounds("geom").alias("_b")).select("bid", *keys, "_b.*").where("minx is not null")
    near = points_in_boxes(points.select("pid", "x", "y", *keys), boxed, cell, keys, half_open=False).select("pid", "x", "y", "bid")
    return near.join(polygons.select("bid", "geom"), "bid").where(wkb_contains("geom", "x", "y")).select("pid", "bid")


def first_polygon(points: DataFrame, polygons: DataFrame, cell: float, keys: list[str] | None = None) -> DataFrame:
    """``points`` with ``bid``, the lowest polygon that holds them; null where none does or the position is unknown.

    The answer depends on a point's place only, and of equal polygons only the lowest can be first: each place and each
    geometry is tested once, however many rows share it.
    """
    at = ["x", "y", *(keys or [])]
    lowest = polygons.groupBy("geom", *(keys or [])).agg(F.min("bid").alias("bid"))
    places = points.dropna(subset=at).groupBy(*at).agg(F.min("pid").alias("pid"))
    first = points_in_polygons(places, lowest, cell, keys).groupBy("pid").agg(F.min("bid").alias("bid"))
    return points.join(places.join(first, "pid").select(*at, "bid"), at, "left")


def group_zone(shapes: DataFrame, group: str) -> DataFrame:
    """(group, epsg): the UTM zone at the mean centroid of each group's shapes, points and lines weighing as 1, polygons by area; else Web Mercator."""
    at = shapes.select(group, wkb_centroid("geom").alias("_c"), F.coalesce(wkb_area("geom"), F.lit(1.0)).alias("_w"))
    mean = lambda c: F.sum(F.col(f"_c.{c}") * F.col("_w")) / F.sum(F.when(F.col(f"_c.{c}").isNotNull(), F.col("_w")))
    return at.groupBy(group).agg(mean("x").alias("x"), mean("y").alias("y")).select(group, utm_epsg(F.col("x"), F.col("y")).alias("epsg"))
