"""Raster algebra on long pixels (row, col, value): masks, islands, zonal statistics, mosaics and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import labelled
from .spatial_join import boxes_to_cells, points_in_boxes


def binarised(value: Column) -> Column:
    """1 above 0, else 0; null and NaN are 0."""
    return F.when(F.nanvl(F.coalesce(value, F.lit(0.0)), F.lit(0.0)) > 0, 1).otherwise(0)


def no_data(value: Column, mark: float | None) -> Column:
    """Null for NaN and the raster's no-data mark."""
    v = F.when(~F.isnan(value), value)
    return v if mark is None else F.when(v != mark, v)


def with_centres(pixels: DataFrame, x0: float, y0: float, size: float) -> DataFrame:
    """Adds x, y of the pixel centres; rows run down from ``y0``."""
    return pixels.withColumn("x", x0 + (F.col("col") + 0.5) * size).withColumn("y", y0 - (F.col("row") + 0.5) * size)


def served_totals(pixels: DataFrame, boxes: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    """By ``keys``: sums of whole pixel values inside (served) and outside (unserved) the boxes of the same keys.

    pixels has x, y, value; values are truncated to whole numbers first, remaining negatives count by size. A semi-join finds the served
    pixels, so boxes that overlap count a pixel once, and the rest is the difference of two grouped sums.
    """
    whole = pixels.withColumn("_v", F.abs(F.coalesce("value", F.lit(0.0)).cast("long")))
    inside = points_in_boxes(whole, boxes, cell, keys, how="left_semi").groupBy(*keys).agg(F.sum("_v").alias("_served"))
    sums = whole.groupBy(*keys).agg(F.sum("_v").alias("total")).join(inside, keys, "left").withColumn("served", F.coalesce("_served", F.lit(0)))
    out = sums.withColumn("unserved", F.col("total") - F.col("served"))
    return out.select(*keys, "served", "unserved", "total", (F.col("served") / (F.col("total") + 0.1)).alias("served_index"))


def zonal(pixels: DataFrame, zones: DataFrame, size: float, cell: float) -> DataFrame:
    """Zonal statistics weighted by coverage: (bid, sum, count, mean, std).

    pixels has minx, miny (lower-left corner) and value, each a square of side ``size``; zones are boxes. The coverage of a pixel is the
    share of its area inside the zone. Sum and deviation are those of values cut off at 0.

    Values at one place are added up before any zone meets them, and zones of the same bounds are met once.
    """
    box = ["minx", "miny", "maxx", "maxy"]
    v = F.greatest("value", F.lit(0.0))
    places = pixels.where("value is not null").groupBy("minx", "miny").agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_v"), F.sum(v * v).alias("_q"))
    spread = boxes_to_cells(places.select("minx", "miny", (F.col("minx") + size).alias("maxx"), (F.col("miny") + size).alias("maxy"), "_n", "_v", "_q"), cell)
    left = spread.select(*[F.col(c).alias(f"p_{c}") for c in box], "_n", "_v", "_q", "_cx", "_cy")
    pairs = left.join(boxes_to_cells(zones.select(*box).distinct(), cell), ["_cx", "_cy"])
    w = F.least("p_maxx", "maxx") - F.greatest("p_minx", "minx")
    h = F.least("p_maxy", "maxy") - F.greatest("p_miny", "miny")
    once = (F.floor(F.greatest("p_minx", "minx") / cell) == F.col("_cx")) & (F.floor(F.greatest("p_miny", "miny") / cell) == F.col("_cy"))
    hit = pairs.withColumn("f", w * h / (size * size)).where((w > 0) & (h > 0) & once)
    each = hit.groupBy(*box).agg(*[F.sum(F.col("f") * F.col(c)).alias(c) for c in ("_n", "_v", "_q")])
    sums = zones.select("bid", *box).join(each, box).groupBy("bid").agg(F.sum("_v").alias("sum"), F.sum("_n").alias("count"), F.sum("_q").alias("_sq"))
    mean = F.col("sum") / F.col("count")
    return sums.select("bid", "sum", "count", mean.alias("mean"), F.sqrt(F.greatest(F.col("_sq") / F.col("count") - mean * mean, F.lit(0.0))).alias("std"))


def islands(pixels: DataFrame, keys: list[str], corners: bool = True) -> DataFrame:
    """Pixels (pid, row, col) with the component of neighbouring pixels of equal ``keys``; ``corners``: eight neighbours, else four."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if corners else [])
    moves = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps]))
    left = pixels.select(*keys, F.col("pid").alias("a"), "row", "col", moves.alias("m")).select(*keys, "a", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"))
    edges = left.join(pixels.select(*keys, F.col("pid").alias("b"), "row", "col"), [*keys, "row", "col"]).select("a", "b")
    return labelled(pixels, "pid", edges)


def large_islands(pixels: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(cluster, pixel_count, pop_sum) of eight-connected islands of populated pixels with at least ``least`` pixels."""
    found = islands(pixels, keys).groupBy("cluster").agg(F.count(F.lit(1)).alias("pixel_count"), F.sum(F.col("value").cast("long")).alias("pop_sum"))
    return found.where((F.col("pop_sum") > 0) & (F.col("pixel_count") >= least))


def mosaic(tiles: DataFrame, mark: float | None = None) -> DataFrame:
    """Pixel-wise sum of overlapping tiles, no-data left out."""
    return tiles.withColumn("value", no_data(F.col("value"), mark)).groupBy("row", "col").agg(F.sum("value").alias("value"))


def rasterised(points: DataFrame, size: float, order: Column | str, mode: str = "last") -> DataFrame:
    """Points (x, y, value) on a grid: the last by ``order`` wins a cell, or values add up (mode ``sum``)."""
    row, col = F.floor(F.col("y") / size).cast("long").alias("row"), F.floor(F.col("x") / size).cast("long").alias("col")
    value = F.max_by("value", order) if mode == "last" else F.sum("value")
    return points.groupBy(row, col).agg(value.alias("value"))


def resampled(pixels: DataFrame, ratio: float) -> DataFrame:
    """Nearest-neighbour resampling to ``ratio`` times the pixel size: each new cell takes the old pixel under its centre."""
    cells = pixels.select(F.floor((F.col("row") + 0.5) / ratio).cast("long").alias("r"), F.floor((F.col("col") + 0.5) / ratio).cast("long").alias("c")).distinct()
    wanted = cells.select(F.col("r"), F.col("c"), F.floor((F.col("r") + 0.5) * ratio).cast("long").alias("row"), F.floor((F.col("c") + 0.5) * ratio).cast("long").alias("col"))
    return wanted.join(pixels, ["row", "col"], "left").select(F.col("r").alias("row"), F.col("c").alias("col"), "value")
