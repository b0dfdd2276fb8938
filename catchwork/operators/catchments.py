"""Catchment orchestration: which sites compete, with what weights, within what bounds, and how overlaps are settled."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .allocation import allocate, grid, with_weights
from .kernel import wkb_area, wkb_bounds, wkb_box
from .overlay import Piece, area_of, as_wkb, in_cells, join, meeting, minus, pieces, wkb_intersection
from .polygon_join import points_in_polygons
from .spatial_join import nearest


@dataclass(frozen=True)
class Approach:
    """How catchments are built: what groups the sites, the metric, and whether weights are used."""

    grouping: str
    metric: str | None = None  # None: the configured one
    weighted: bool = False
    only_round: bool = False
    buffered: bool = False


def _variants(number: str, grouping: str, buffered: bool) -> dict[str, Approach]:
    kinds = [(m, r) for m in ("multiplicative", "additive") for r in (False, True)]
    return {number + letter: Approach(grouping, m, True, r, buffered) for letter, (m, r) in zip("abcd", kinds, strict=True)}


#: The approaches by name.
APPROACHES = {
    "0": Approach("plant"), **_variants("1", "plant", False),
    "2": Approach("basin", buffered=True), **_variants("3", "basin", True),
    "4": Approach("city"), "5": Approach("city", weighted=True),
}


def initial_weights(sites: DataFrame, group: str, metric: str, weighted: bool) -> DataFrame:
    """Sites (sid, sx, sy, weight, group) with the weights that allocation starts from, adding up to 1 in a group unless all are 0.

    Multiplicative: as they are, or 1 each without weighting. Additive: times the mean distance to the nearest other site of the group,
    or 0 without weighting; a group of one site has no such distance, and keeps its weight.
    """
    if metric == "multiplicative":
        own = sites if weighted else sites.withColumn("weight", F.lit(1.0))
    elif not weighted:
        return sites.withColumn("weight", F.lit(0.0))
    else:
        near = nearest(sites.select("sid", "sx", "sy", group), sites.select(F.col("sid").alias("tid"), F.col("sx").alias("tx"), F.col("sy").alias("ty"), group), [group], other=True)
        scale = sites.select("sid", group).join(near.select("sid", "dist"), "sid").groupBy(group).agg(F.avg("dist").alias("_scale"))
        return sites.join(scale, group, "left").withColumn("weight", F.col("weight") * F.coalesce("_scale", F.lit(1.0))).drop("_scale")
    total = own.groupBy(group).agg(F.sum("weight").alias("_total"))
    return own.join(total, group, "left").withColumn("weight", F.coalesce(F.try_divide("weight", "_total"), F.lit(0.0))).drop("_total")


def cells_inside(cells: DataFrame, bounds: DataFrame, group: str, size: float) -> DataFrame:
    """Grid cells (group, i, j, x, y) whose centre lies in a bound (bid, geom) of their group."""
    named = cells.withColumn("pid", F.struct(group, "i", "j"))
    return cells.join(points_in_polygons(named, bounds, size, [group]).select("pid.*").distinct(), [group, "i", "j"], "left_semi")


def clipped_cells(cells: DataFrame, bounds: DataFrame, group: str, step: float, size: float) -> DataFrame:
    """Allocated cells (group, i, j, x, y, site) cut to the bounds (bid, geom) of their group: rows with ``geom`` and ``area``.

    A region is the union of its rows, whose inner parts don't overlap unless the bounds do.
    """
    half = step / 2
    squares = cells.withColumn("bid", F.struct(group, "i", "j")).withColumn("geom", wkb_box(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half))
    met = meeting(squares.select("bid", "geom", group), bounds.select("bid", "geom", group), size, [group])
    parts = met.select("a.*", F.col("b").alias("bound"), wkb_intersection("a_geom", "b_geom").alias("geom")).where("geom is not null")
    return cells.drop("geom").join(parts, [group, "i", "j"]).withColumn("area", wkb_area("geom"))


_KEPT = T.ArrayType(T.StructType([T.StructField("bid", T.LongType()), T.StructField("geom", T.BinaryType()), T.StructField("area", T.DoubleType())]))


@F.pandas_udf(_KEPT)
def _settled(lists: pd.Series) -> pd.Series:
    def one(rows: list) -> list:
        taken: list[Piece] = []
        out = []
        for r in rows:
            own = minus(pieces(bytes(r["geom"])), taken)
            taken = taken + own
            if own:
                out.append({"bid": r["bid"], "geom": as_wkb(own), "area": float(sum(map(area_of, own)))})
        return out

    return pd.Series([one(x) for x in lists], dtype=object)


def settle_overlaps(shapes: DataFrame, cell: float, keys: list[str] | None = None) -> DataFrame:
    """(keys..., bid, _cx, _cy, geom, area): polygons (bid, geom) of equal ``keys`` without overlaps, by grid cell.

    Of two that overlap, the one with the larger whole area loses the common part; of equal ones that with the lower id. Areas are those
    before any cut, so the order of rows doesn't matter; polygons that lose everything have no row.
    """
    keys = keys or []
    ranked = shapes.select(*keys, F.col("bid").cast("long").alias("bid"), "geom", wkb_area("geom").alias("_whole")).where("_whole is not null")
    order = F.sort_array(F.collect_list(F.struct(F.col("_whole"), (-F.col("bid")).alias("_last"), "bid", "geom")))
    parts = in_cells(ranked, cell).groupBy(*keys, "_cx", "_cy").agg(order.alias("_all"))
    return parts.select(*keys, "_cx", "_cy", F.explode(_settled("_all")).alias("_s")).select(*keys, "_s.bid", "_cx", "_cy", "_s.geom", "_s.area")


def catchments(sites: DataFrame, bounds: DataFrame, approach: Approach, group: str, value: str, step: float, metric: str = "multiplicative", method: str = "sqrt") -> DataFrame:
    """Cells of the catchments of sites (sid, sx, sy, group, value) within the bounds (bid, geom, group): (group, i, j, x, y, site, ..., geom, area).

    Weights are shares of ``value`` in the group, the grid covers the group's bounds, cells whose centre is outside are left out, the rest go
    to the site of least weighted distance and are cut to the bounds. Groups without sites or without bounds have no rows.
    """
    kind = approach.metric or metric
    weighed = initial_weights(with_weights(sites, value, group, method) if approach.weighted else sites.withColumn("weight", F.lit(1.0)), group, kind, approach.weighted)
    box = bounds.select(group, wkb_bounds("geom").alias("_b")).groupBy(group).agg(*[f(f"_b.{c}").alias(c) for c, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))])
    cells = cells_inside(grid(box.where("minx is not null"), group, step), bounds, group, step * 8)
    return clipped_cells(allocate(cells, weighed.select("sid", "sx", "sy", "weight", group), group, kind), bounds, group, step, step * 8)
