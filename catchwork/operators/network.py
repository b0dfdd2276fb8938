"""Directed river networks: levels, common downstream nodes, and downstream propagation of decaying loads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import decay_rate, last_sample
from ..plans.stage import checkpointed


def levels(edges: DataFrame) -> DataFrame:
    """(id, level, outlet): steps to the outlet by pointer doubling, in a logarithmic number of joins.

    edges has id and next_down (0 or null: outlet). A node that never reaches an outlet (cycle) has null level.
    """
    state = checkpointed(edges.select("id", F.coalesce("next_down", F.lit(0)).alias("jump"), F.lit(1).cast("long").alias("d"), F.col("id").alias("last")))
    size, known, moving = state.count(), state, state.where("jump <> 0")
    done = state.where("jump = 0")
    rounds = max(1, int(np.ceil(np.log2(size + 1)))) if size else 0
    for _ in range(rounds):
        if moving.isEmpty():
            break
        # finished nodes stay aside: only those still on their way are joined, by keys that are all different on the other side
        other = known.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("d").alias("_d"), F.col("last").alias("_last"))
        moved = moving.join(other, F.col("jump") == F.col("_id"), "left")
        state = checkpointed(
            moved.select(
                "id",
                F.when(F.col("_id").isNull(), F.lit(0)).otherwise(F.col("_jump")).alias("jump"),
                (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"),
                F.coalesce("_last", "last").alias("last"),
            )
        )
        done, moving = done.unionByName(state.where("jump = 0")), state.where("jump <> 0")
        known = done.unionByName(moving)
    none = moving.select("id", F.lit(None).cast("long").alias("level"), F.lit(None).cast(edges.schema["id"].dataType).alias("outlet"))
    return done.select("id", (F.col("d") - 1).alias("level"), F.col("last").alias("outlet")).unionByName(none)


def closure(edges: DataFrame, sources: DataFrame, depth: int = 10_000) -> DataFrame:
    """(src, node, depth): the downstream path of each source, itself included, by doubling: a logarithmic number of joins.

    Paths of fewer than 2^k steps, each carried on by 2^k steps, are those of 2^k to 2^(k+1) - 1 steps. A path of over ``depth``
    steps, as in a cycle, is an error, not a shorter path.
    """
    cut = F.raise_error(F.lit(f"a path of over {depth} steps: a cycle, or a larger depth is wanted")).cast("int")
    jump = edges.where("next_down <> 0").select(F.col("id").alias("_from"), F.col("next_down").alias("_to"))
    found, step = sources.select("src", F.col("src").alias("node"), F.lit(0).alias("depth")), 1
    while step <= depth + 1:
        jump = checkpointed(jump)
        far = checkpointed(found.join(jump, F.col("node") == F.col("_from")).select("src", F.col("_to").alias("node"), (F.col("depth") + step).alias("depth")))
        if far.isEmpty():
            break
        found, step = found.unionByName(far), 2 * step
        jump = jump.join(jump.select(F.col("_from").alias("_mid"), F.col("_to").alias("_end")), F.col("_to") == F.col("_mid")).select("_from", F.col("_end").alias("_to"))
    return found.withColumn("depth", F.when(F.col("depth") > depth, cut).otherwise(F.col("depth")))


def first_common(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(poly, node): the first node downstream of all members of each polygon; a member alone is its own.

    paths is a closure; members has poly and src. Null where the members never meet.
    """
    size = members.groupBy("poly").agg(F.count_distinct("src").alias("members"))
    met = members.distinct().join(paths, "src").groupBy("poly", "node").agg(F.count_distinct("src").alias("n"), F.sum("depth").alias("far"))
    best = met.join(size, "poly").where("n = members").groupBy("poly").agg(F.min(F.struct("far", "node")).alias("best"))
    return size.select("poly").join(best, "poly", "left").select("poly", F.col("best.node").alias("node"))


def propagate(segments: DataFrame, limit: float, by: str = "main_riv") -> DataFrame:
    """(id, level, inflow, ratio, alive, outflow): loads carried from the highest level to the outlet.

    segments has id, next_down, ``by``, pop, q, length, lat. A segment's load is what its upstream segments hand on plus its own
    population's load. Decay and limits follow
    ``formulas``. One river system is one group: its segments are walked once, upstream first, in linear time.
    """
    own = segments.select("id", F.coalesce("next_down", F.lit(0)).alias("next_down"), by, F.coalesce("pop", F.lit(0.0)).alias("pop"), F.coalesce(F.nullif("q", F.lit(0.0)), F.lit(0.269)).alias("q"), decay_rate(F.col("lat")).alias("k"), last_sample(F.col("length")).alias("d"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").drop_duplicates("id")
        place = {i: k for k, i in enumerate(pdf["id"])}
        down = np.array([place.get(n, -1) for n in pdf["next_down"]])
        n, waits = len(pdf), np.zeros(len(pdf), int)
        np.add.at(waits, down[down >= 0], 1)
        ready, level_of, order = [k for k in range(n) if waits[k] == 0], np.full(n, -1), []
        while ready:
            k = ready.pop()
            order.append(k)
            if down[k] >= 0:
                waits[down[k]] -= 1
                if waits[down[k]] == 0:
                    ready.append(down[k])
        for k in reversed(order):
            level_of[k] = 0 if down[k] < 0 else level_of[down[k]] + 1
        inflow, ratio, alive, out = np.zeros(n), np.zeros(n), np.zeros(n, bool), np.zeros(n)
        fresh = pdf["pop"].to_numpy() * (60 / 86.4) / (pdf["q"].to_numpy() * 1000)
        fade = np.exp(-pdf["k"].to_numpy() * pdf["d"].to_numpy() / 86400)
        for k in order:
            ratio[k] = (inflow[k] + fresh[k]) / limit
            end = ratio[k] * fade[k]
            alive[k] = end / limit >= 1
            out[k] = end * limit if alive[k] else 0.0
            if down[k] >= 0:
                inflow[down[k]] += out[k]
        got = np.array(order, int)
        return pd.DataFrame({"id": pdf["id"].to_numpy()[got], "level": level_of[got], "inflow": inflow[got], "ratio": ratio[got], "alive": alive[got], "outflow": out[got]})

    return own.groupBy(by).applyInPandas(walk, "id long, level long, inflow double, ratio double, alive boolean, outflow double")


def longest_overlap(pieces: DataFrame) -> DataFrame:
    """Of the pieces (id, basin, length) of each line, the basin with the longest; ties: the lowest basin."""
    return pieces.groupBy("id").agg(F.max_by("basin", F.struct("length", -F.col("basin"))).alias("basin"), F.max("length").alias("length"))
