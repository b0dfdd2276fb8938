"""Spatial joins as equi-joins on grid cells with an exact residual, so that no pair of tables is joined by a nested loop.

Skew: a cell is as large as the radius or the given size; hot cells are split by adaptive skew joins. Residuals are column
expressions for points and boxes, and Arrow kernels for polygons and lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import checkpointed


def distance(ax: Column | str, ay: Column | str, bx: Column | str, by: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (ax, ay)), (F.col(c) if isinstance(c, str) else c for c in (bx, by))
    (x0, y0), (x1, y1) = a, b
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def _cell(c: Column | str, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("long")


def within_radius(src: DataFrame, tgt: DataFrame, radius: float, keys: list[str] | None = None, closed: bool = False) -> DataFrame:
    """Pairs (sid, tid, dist) nearer than ``radius`` (or as near, if ``closed``).

    src has sid, sx, sy and tgt has tid, tx, ty; both have ``keys``, which must be equal.
    """
    keys, around = keys or [], F.array(*[F.lit(d) for d in (-1, 0, 1)])
    left = src.where("sx is not null and sy is not null").withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    left = left.withColumn("_cx", _cell("sx", radius) + F.col("_dx")).withColumn("_cy", _cell("sy", radius) + F.col("_dy")).select("sid", "sx", "sy", *keys, "_cx", "_cy")
    right = tgt.where("tx is not null and ty is not null").select("tid", "tx", "ty", *keys, _cell("tx", radius).alias("_cx"), _cell("ty", radius).alias("_cy"))
    pairs = left.join(right, [*keys, "_cx", "_cy"]).withColumn("dist", distance("sx", "sy", "tx", "ty"))
    return pairs.where(F.col("dist") <= radius if closed else F.col("dist") < radius).select("sid", "tid", "dist")


def nearest_within(src: DataFrame, tgt: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """(sid, tid, dist) of each source's nearest target nearer than ``radius``; nulls where there is none. Ties: lowest tid."""
    best = within_radius(src, tgt, radius, keys).groupBy("sid").agg(F.min(F.struct("dist", "tid")).alias("best"))
    return src.select("sid").join(best, "sid", "left").select("sid", F.col("best.tid").alias("tid"), F.col("best.dist").alias("dist"))


def nearest(src: DataFrame, tgt: DataFrame, keys: list[str] | None = None, start: float | None = None, other: bool = False) -> DataFrame:
    """Unbounded 1-NN by search rings: the radius doubles for the sources that have found nothing yet.

    ``other`` leaves a source's own id out (self joins). A match within the radius is exact. The first radius is about the spacing of targets; the last covers all of them.
    """
    keys = keys or []
    box = tgt.agg(F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1"), F.count("tx").alias("n")).first()
    ext = src.agg(F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1")).first()
    if not box["n"] or ext["x0"] is None:
        return src.select("sid", F.lit(None).cast(tgt.schema["tid"].dataType).alias("tid"), F.lit(None).cast("double").alias("dist"))
    reach = math.hypot(max(box["x1"], ext["x1"]) - min(box["x0"], ext["x0"]), max(box["y1"], ext["y1"]) - min(box["y0"], ext["y0"])) + 1e-9
    radius = start or max(reach / max(1.0, math.sqrt(box["n"])), reach / 2**20)
    left, found = checkpointed(src.select("sid", "sx", "sy", *keys)), []
    while True:
        pairs = within_radius(left, tgt, radius, keys, closed=True)
        hit = (pairs.where("sid <> tid") if other else pairs).groupBy("sid").agg(F.min(F.struct("dist", "tid")).alias("best"))
        got = checkpointed(hit.select("sid", F.col("best.tid").alias("tid"), F.col("best.dist").alias("dist")))
        found.append(got)
        left = checkpointed(left.join(got.select("sid"), "sid", "left_anti"))
        if radius > reach or left.isEmpty():
            break
        radius *= 2
    none = left.select("sid", F.lit(None).cast(tgt.schema["tid"].dataType).alias("tid"), F.lit(None).cast("double").alias("dist"))
    for f in found:
        none = none.unionByName(f)
    return none


def unmatched_targets(src: DataFrame, tgt: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Targets without a source within ``radius``."""
    near = within_radius(src, tgt, radius, keys, closed=True).select("tid").distinct()
    return tgt.join(near, "tid", "left_anti")


def boxes_to_cells(boxes: DataFrame, size: float) -> DataFrame:
    """Boxes (bid, minx, miny, maxx, maxy) with a row for each grid cell they meet."""
    xs, ys = F.sequence(_cell("minx", size), _cell("maxx", size)), F.sequence(_cell("miny", size), _cell("maxy", size))
    return boxes.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, keys: list[str] | None = None, how: str = "inner", half_open: bool = True) -> DataFrame:
    """Points (pid, x, y) with the boxes that hold them; ``half_open`` leaves the upper sides out. ``left`` keeps all points."""
    keys = keys or []
    cells = boxes_to_cells(boxes, size)
    inside = (F.col("x") >= F.col("minx")) & (F.col("y") >= F.col("miny"))
    inside &= (F.col("x") < F.col("maxx")) & (F.col("y") < F.col("maxy")) if half_open else (F.col("x") <= F.col("maxx")) & (F.col("y") <= F.col("maxy"))
    placed = points.withColumn("_cx", _cell("x", size)).withColumn("_cy", _cell("y", size))
    cells = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cx").alias("_bx"), F.col("_cy").alias("_by"), *[c for c in boxes.columns if c not in keys])
    on = (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by")) & inside
    for i, k in enumerate(keys):
        on &= F.col(k) == F.col(f"_k{i}")
    return placed.join(cells, on, how).drop("_cx", "_cy", "_bx", "_by", *[f"_k{i}" for i in range(len(keys))])


def overlapping_boxes(boxes: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of boxes that meet (touching counts), each once: a pair is found in the cell of its common corner."""
    keys = keys or []
    cells = boxes_to_cells(boxes, size)
    side = lambda p: cells.select(*keys, "_cx", "_cy", *[F.col(c).alias(f"{p}_{c}") for c in ("bid", "minx", "miny", "maxx", "maxy")])
    pairs = side("a").join(side("b"), [*keys, "_cx", "_cy"]).where("a_bid < b_bid and a_minx <= b_maxx and b_minx <= a_maxx and a_miny <= b_maxy and b_miny <= a_maxy")
    once = (F.col("_cx") == _cell(F.greatest("a_minx", "b_minx"), size)) & (F.col("_cy") == _cell(F.greatest("a_miny", "b_miny"), size))
    return pairs.where(once).select(F.col("a_bid").alias("a"), F.col("b_bid").alias("b"))
