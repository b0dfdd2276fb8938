"""Numeric formulas of the domain: loads, decay, comparison measures, sizes and weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Grams a head and day over seconds a day, smallest discharge, and the decay law.
HEAD_LOAD = 60 / 86.4
LEAST_FLOW = 0.269
DECAY, DECAY_BASE = 0.23, 1.047
SAMPLE = 100.0


def flow(q: Column) -> Column:
    return F.coalesce(F.nullif(q, F.lit(0.0)), F.lit(LEAST_FLOW))


def load_ratio(pop: Column, q: Column, limit: float, load: Column | None = None) -> Column:
    """Concentration over its limit: of a population in a discharge, or of a load handed on."""
    fresh = pop * HEAD_LOAD / (flow(q) * 1000) / limit
    return fresh if load is None else F.coalesce(load / limit, fresh)


def decay_rate(lat: Column) -> Column:
    return DECAY * F.pow(F.lit(DECAY_BASE), 28 * F.cos(F.radians(F.abs(lat))) - 20)


def last_sample(length: Column) -> Column:
    """Distance of the last sample along a segment: every 100 m, or the end of a segment with fewer than two."""
    n = F.ceil(length / SAMPLE)
    return F.when(n >= 2, (n - 1) * SAMPLE).otherwise(length)


def plume(ratio: Column, length: Column, lat: Column, limit: float) -> tuple[Column, Column]:
    """(alive to the end, load that leaves): decay is monotone, so the last sample decides."""
    end = ratio * F.exp(-decay_rate(lat) * last_sample(length) / 86400)
    alive = end / limit >= 1
    return alive, F.when(alive, end * limit).otherwise(0.0)


def ndi(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where that is undefined."""
    return F.try_divide(a - b, a + b)


def multiple(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, b) + 1


def served_index(served: Column, unserved: Column) -> Column:
    return served / (served + unserved + 0.1)


def site_weights(x: Column, group: str, method: str = "sqrt", sigma: float = 3.0, pct: float = 10.0) -> list[tuple[str, Column]]:
    """Steps (name, column) to in-group weights: zeros to the mean, transform, share, clip about the median, share again.

    Apply them in order with ``withColumn``; the result is ``weight``.
    """
    w = Window.partitionBy(group)
    shape = {"linear": lambda c: c, "log": F.log1p, "sqrt": F.sqrt, "sigmoid": lambda c: c}[method]
    filled = F.when(F.coalesce(x, F.lit(0.0)) == 0, F.coalesce(F.avg(x).over(w), F.lit(0.0))).otherwise(x)
    steps = [("_filled", filled), ("_shaped", shape(F.col("_filled")))]
    if method == "sigmoid":
        z = (F.col("_filled") - F.avg("_filled").over(w)) / (F.stddev_samp("_filled").over(w) + 1e-9)
        steps[1] = ("_shaped", F.coalesce(1 / (1 + F.exp(-z)), F.lit(1.0)))
    even = 1.0 / F.count(F.lit(1)).over(w)
    middle, spread = F.col("_middle"), F.col("_spread")
    clipped = F.when(spread > 0, F.least(F.greatest(F.col("_share"), middle / pct), middle + sigma * spread)).otherwise(F.col("_share"))
    return [
        *steps,
        ("_share", F.coalesce(F.try_divide(F.col("_shaped"), F.sum("_shaped").over(w)), even)),
        ("_middle", F.median("_share").over(w)),
        ("_spread", F.stddev_samp("_share").over(w)),
        ("_clipped", clipped),
        ("weight", F.coalesce(F.try_divide(F.col("_clipped"), F.sum("_clipped").over(w)), even)),
    ]


def adaptive_count(span: Column, step: float, least_step: float) -> Column:
    """Steps in a span: the step is halved while it exceeds the span, but not under ``least_step``; at least one."""
    halvings = F.greatest(F.ceil(F.log2(F.lit(step) / F.greatest(span, F.lit(1e-9)))), F.lit(0))
    most = math.floor(math.log2(step / least_step))
    own = F.lit(step) / F.pow(F.lit(2.0), F.least(halvings, F.lit(most)))
    return F.greatest(F.floor(span / own), F.lit(1)).cast("int")


def size_scale(value: Column, low: Column, high: Column, least: float, most: float, log: bool = False) -> Column:
    """Size between ``least`` and ``most`` by a linear or logarithmic scale."""
    v, a, b = (F.log1p(value), F.log1p(low), F.log1p(high)) if log else (value, low, high)
    return least + (most - least) * F.coalesce(F.try_divide(v - a, b - a), F.lit(0.0))
