"""Weighted-Voronoi allocation: grid cells go to the site of least weighted distance, and regions are the sums of their cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import site_weights


def with_weights(sites: DataFrame, value: str, group: str, method: str = "sqrt", sigma: float = 3.0, pct: float = 10.0) -> DataFrame:
    """Sites with ``weight``: shares within the group, clipped about the median, adding up to 1."""
    out = sites
    for name, column in site_weights(F.col(value), group, method, sigma, pct):
        out = out.withColumn(name, column)
    return out.drop("_filled", "_shaped", "_share", "_middle", "_spread", "_clipped")


def weighted_distance(d: Column, w: Column, metric: str) -> Column:
    """Multiplicative d / w, or additive sqrt(d^2 - w^2) with what is negative set to 0.01 before the root; a zero weight loses."""
    if metric == "multiplicative":
        return F.coalesce(F.try_divide(d, w), F.lit(float("inf")))
    rest = d * d - w * w
    return F.sqrt(F.when(rest < 0, 0.01).otherwise(rest))


def grid(groups: DataFrame, group: str, step: float) -> DataFrame:
    """Cell centres (cell, x, y) of the boxes (minx, miny, maxx, maxy) of each group."""
    n = lambda a, b: F.greatest(F.floor((F.col(b) - F.col(a)) / step), F.lit(1)).cast("int")
    cols = F.explode(F.sequence(F.lit(0), n("minx", "maxx") - 1)).alias("i")
    placed = groups.select(group, "minx", "miny", n("miny", "maxy").alias("_rows"), cols).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    return placed.select(group, "i", "j", (F.col("minx") + (F.col("i") + 0.5) * step).alias("x"), (F.col("miny") + (F.col("j") + 0.5) * step).alias("y"))


def allocate(cells: DataFrame, sites: DataFrame, group: str, metric: str = "multiplicative") -> DataFrame:
    """Cells with ``site``: the site of the same group at the least weighted distance; ties: the lowest site.

    The sites of a group travel as one array, so the join has a row a group and the minimum is taken within the cell's row: no
    cell is ever paired with a site as a row of its own.
    """
    packed = sites.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col("sid"), F.col("sx"), F.col("sy"), F.col("weight")))).alias("_sites"))
    both = cells.join(packed, group)

    def score(s: Column) -> Column:
        dx, dy = F.col("x") - s["sx"], F.col("y") - s["sy"]
        return F.struct(weighted_distance(F.sqrt(dx * dx + dy * dy), s["weight"], metric).alias("d"), s["sid"].alias("sid"))

    best = F.array_min(F.transform("_sites", score))
    return both.withColumn("site", best["sid"]).withColumn("distance", best["d"]).drop("_sites")


def regions(cells: DataFrame, group: str, step: float) -> DataFrame:
    """(group, site, n_cells, area, minx, miny, maxx, maxy) of each region."""
    return cells.groupBy(group, "site").agg(
        F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) * step * step).alias("area"),
        (F.min("x") - step / 2).alias("minx"), (F.min("y") - step / 2).alias("miny"), (F.max("x") + step / 2).alias("maxx"), (F.max("y") + step / 2).alias("maxy"),
    )


def outline(cells: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Rings about a union of unit cells (i, j): outer rings run counter-clockwise, holes clockwise."""
    own, edges = set(cells), {}
    for i, j in own:
        for (di, dj), a, b in (((0, -1), (i, j), (i + 1, j)), ((1, 0), (i + 1, j), (i + 1, j + 1)), ((0, 1), (i + 1, j + 1), (i, j + 1)), ((-1, 0), (i, j + 1), (i, j))):
            if (i + di, j + dj) not in own:
                edges.setdefault(a, []).append(b)
    rings = []
    while edges:
        start = min(edges)
        ring, at, back = [start], start, None
        while True:
            ways = edges[at]
            # where two corners touch, turn left, so that regions joined at a corner alone stay apart
            b = ways[0] if len(ways) == 1 or back is None else max(ways, key=lambda w: (w[1] - at[1]) * (at[0] - back[0]) - (w[0] - at[0]) * (at[1] - back[1]))
            ways.remove(b)
            if not ways:
                del edges[at]
            back, at = at, b
            if at == start:
                break
            ring.append(at)
        keep = [p for q, p, r in zip([ring[-1], *ring[:-1]], ring, [*ring[1:], ring[0]], strict=True) if (p[0] - q[0]) * (r[1] - p[1]) != (p[1] - q[1]) * (r[0] - p[0])]
        rings.append(keep)
    return rings


def region_outlines(cells: DataFrame, group: str) -> DataFrame:
    """(group, site, rings): the outlines of each region in cell corners; one region is one group of the kernel."""

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = outline(list(zip(pdf["i"].tolist(), pdf["j"].tolist(), strict=True)))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "site": [pdf["site"].iloc[0]], "rings": [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]]})

    kind = cells.schema[group].dataType.simpleString()
    site = cells.schema["site"].dataType.simpleString()
    return cells.select(group, "site", "i", "j").groupBy(group, "site").applyInPandas(trace, f"{group} {kind}, site {site}, rings array<array<struct<x:double,y:double>>>")

