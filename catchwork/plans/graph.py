"""Connected components by alternating large-star and small-star rounds.

Both rounds are a grouped minimum (combined map-side, so a hub is no hot group) and a join of that
minimum back to the edges, which adaptive execution can split at a hub. The number of rounds grows with
the logarithm of the graph's size. Each round is cut off by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on edges (u > v): each node's larger (or smaller) neighbours go to its minimum."""
    if large:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select("u", "v")
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = sides.join(least, F.col("u") == F.col("k"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of the component.

    Nulls, loops and repeated edges are ignored.
    """
    own = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null").where("u > v").distinct()
    own = checkpointed(own)
    seen = None
    while True:
        state = own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        own = checkpointed(_star(_star(own, True), False))
    # at rest every node hangs on its root
    return own.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
