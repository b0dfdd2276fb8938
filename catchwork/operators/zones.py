"""Polygon zones over rasters: coverage shares, masks, signed totals, zonal statistics, and shapes cut by map tiles.

Zones are cut by the pixel grid itself, coarse blocks first, so pixels and zones meet by whole-number cells and no pair is tested.
Pixel (px, py) is the square from (px, py) times the pixel size to the next whole numbers. Null, broken and empty zones cover nothing; a null value is no data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo as g
from .kernel import distinct_shapes, shape_id, wkb_area, wkb_bounds, wkb_box
from .overlay import area_of, in_cells, pieces, strips, wkb_intersection
from .polygon_join import points_in_polygons

#: Pixels along the side of a block of the first cut.
BLOCK = 16


_SHARE = T.StructType([T.StructField("px", T.LongType()), T.StructField("py", T.LongType()), T.StructField("share", T.DoubleType())])


@F.pandas_udf(T.ArrayType(_SHARE))
def _shares(g: pd.Series, size: pd.Series) -> pd.Series:
    """The pixels that each polygon covers, with the share of their area: convex pieces are cut to rows, those to pixels."""

    def one(data: bytes, size: float) -> list[dict]:
        found: dict[tuple[int, int], float] = {}
        for piece in pieces(bytes(data)):
            for py, row in strips(piece, 1, size):
                for px, own in strips(row, 0, size):
                    found[px, py] = found.get((px, py), 0.0) + area_of(own)
        return [{"px": px, "py": py, "share": area / (size * size)} for (px, py), area in found.items()]

    return pd.Series([one(x, s) for x, s in zip(g, size, strict=True)], dtype=object)


def coverage(zones: DataFrame, size: float, block: int = BLOCK) -> DataFrame:
    """Zones (bid, geom, ...) as rows (bid, ..., px, py, share): the share of each pixel's area that a zone covers, where it is above 0."""
    coarse = in_cells(zones, size * block).drop("_cx", "_cy")
    shares = coarse.withColumn("_p", F.explode(_shares("geom", F.lit(size)))).drop("geom")
    fine = shares.select("*", "_p.px", "_p.py", "_p.share").drop("_p")
    # a pixel on the border of two blocks may be cut twice by rounding
    return fine.groupBy(*[c for c in fine.columns if c not in ("geom", "share")]).agg(F.sum("share").alias("share"))


def zonal_in_polygons(pixels: DataFrame, zones: DataFrame, size: float, rounded: bool = False) -> DataFrame:
    """(bid, sum, count, mean, std) of pixels (px, py, value), weighted by coverage; values below 0 count as 0 in sum and deviation.

    ``rounded``: sum to the nearest whole number and count cut to one. Equal geometries are cut once, whatever the number of their zones.
    """
    v = F.greatest("value", F.lit(0.0))
    places = pixels.where("value is not null").groupBy("px", "py").agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_v"), F.sum(v * v).alias("_q"))
    hit = coverage(distinct_shapes(zones), size).join(places, ["px", "py"])
    each = hit.groupBy(F.col("bid").alias("_shape")).agg(*[F.sum(F.col("share") * F.col(c)).alias(c) for c in ("_n", "_v", "_q")])
    own = zones.select("bid", shape_id("geom").alias("_shape")).join(each, "_shape")
    sums = own.groupBy("bid").agg(F.sum("_v").alias("sum"), F.sum("_n").alias("count"), F.sum("_q").alias("_sq"))
    mean = F.col("sum") / F.col("count")
    std = F.sqrt(F.greatest(F.col("_sq") / F.col("count") - mean * mean, F.lit(0.0)))
    whole = (lambda c: c.cast("long")) if rounded else (lambda c: c)
    return sums.select("bid", whole(F.round("sum") if rounded else F.col("sum")).alias("sum"), whole(F.col("count")).alias("count"), mean.alias("mean"), std.alias("std"))


def masked(pixels: DataFrame, zones: DataFrame, cell: float, keys: list[str] | None = None, inside: bool = False) -> DataFrame:
    """Pixels (pid, x, y, ...) whose centre lies in no zone (or, with ``inside``, in at least one) of equal ``keys``."""
    hit = points_in_polygons(pixels.where("x is not null and y is not null"), zones, cell, keys).select("pid").distinct()
    return pixels.join(hit, "pid", "left_semi" if inside else "left_anti")


def signed(pixels: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """Pixels (px, py, value, ...) as whole numbers: positive where a zone touches the pixel's area, else negative; no data is 0."""
    touched = coverage(distinct_shapes(zones).select("geom"), size).select("px", "py").distinct().withColumn("_in", F.lit(True))
    size_of = F.abs(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).cast("long"))
    return pixels.join(touched, ["px", "py"], "left").withColumn("value", F.when(F.col("_in"), size_of).otherwise(-size_of)).drop("_in")


def signed_totals(pixels: DataFrame, zones: DataFrame, size: float, by: list[str]) -> DataFrame:
    """(by..., sum_pos, sum_neg) of the signed raster."""
    v = F.col("value")
    return signed(pixels, zones, size).groupBy(*by).agg(F.sum(F.greatest(v, F.lit(0))).alias("sum_pos"), F.sum(F.least(v, F.lit(0))).alias("sum_neg"))


def by_tile(found: DataFrame, size: Column | float, zoom: int) -> DataFrame:
    """Pixels (minx, miny, value, ...) cut by map tiles: a row for each tile, with ``tile`` and the ``share`` of the pixel's area in it."""
    maxx, maxy = F.col("minx") + size, F.col("miny") + size
    cut = found.withColumn("tile", F.explode(g.tiles_of_box(F.col("minx"), F.col("miny"), maxx, maxy, zoom)))
    x0, y0, x1, y1 = g.tile_box(F.col("tile"))
    w, h = F.least(maxx, x1) - F.greatest(F.col("minx"), x0), F.least(maxy, y1) - F.greatest(F.col("miny"), y0)
    return cut.withColumn("share", F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) / (size * size)).where("share > 0")


def island_zones(found: DataFrame, size: float, zoom: int, least: float) -> DataFrame:
    """(cluster, tile, pixel_count, pop_sum) of islands of pixels (cluster, minx, miny, value) split by tiles.

    Both are weighted by coverage, rounded sum and cut count; parts without population or of fewer than ``least`` pixels go.
    """
    sums = by_tile(found, size, zoom).groupBy("cluster", "tile").agg(F.sum("share").alias("_n"), F.sum(F.col("share") * F.greatest("value", F.lit(0.0))).alias("_v"))
    # shares that add up to a whole number may fall short of it by rounding
    out = sums.select("cluster", "tile", F.floor(F.round("_n", 9)).cast("long").alias("pixel_count"), F.round(F.round("_v", 6)).cast("long").alias("pop_sum"))
    return out.where((F.col("pop_sum") > 0) & (F.col("pixel_count") >= least))


def cut_by_tiles(shapes: DataFrame, zoom: int) -> DataFrame:
    """Polygons (bid, geom, ...) with a row for each tile that they overlap, ``geom`` cut to it; those without bounds keep a row with a null tile."""
    boxed = shapes.withColumn("_b", wkb_bounds("geom"))
    tiles = g.tiles_of_box(F.col("_b.minx"), F.col("_b.miny"), F.col("_b.maxx"), F.col("_b.maxy"), zoom)
    spread = boxed.withColumn("tile", F.explode_outer(F.when(F.col("_b.minx").isNotNull(), tiles))).drop("_b")
    own = spread.where("tile is not null").withColumn("geom", wkb_intersection("geom", wkb_box(*g.tile_box(F.col("tile"))))).where("geom is not null")
    return own.unionByName(spread.where("tile is null"))
