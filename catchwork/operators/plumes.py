"""Plume ribbons: strips of a radius along the live part of a river segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formulas as fx
from .kernel import POLYGON, dumps
from .overlay import lines_of

#: How far ahead the direction at a sample is taken, in metres.
AHEAD = 0.1


def ribbon(line: bytes | None, ratio: float, decay: float, limit: float, radius: float) -> bytes | None:
    """The strip of ``radius`` on both sides of a line, as far as its load stays at the limit: through samples of every 100 m (or both ends).

    None for a null or empty line, a ratio below 1 or unknown, or fewer than two live samples.
    """
    paths = lines_of(line)
    if not paths or not ratio >= 1 or not radius > 0:
        return None
    path = np.vstack(paths)
    along = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(path, axis=0).T))])
    at = np.arange(0, along[-1], fx.SAMPLE)
    at = at if len(at) > 1 else np.array([0.0, along[-1]])
    live = ratio * np.exp(-decay * at / 86400) / limit >= 1
    at = at if live.all() else at[: int(np.argmin(live))]
    if len(at) < 2:
        return None
    place = lambda d: np.stack([np.interp(d, along, path[:, c]) for c in (0, 1)], axis=1)
    here = place(at)
    step = place(np.minimum(at + AHEAD, along[-1])) - place(np.maximum(np.minimum(at + AHEAD, along[-1]) - AHEAD, 0))
    length = np.hypot(*step.T)[:, None]
    side = np.stack([-step[:, 1], step[:, 0]], axis=1) / np.where(length == 0, 1.0, length) * radius
    ring = np.concatenate([here + side, (here - side)[::-1]])
    return dumps(POLYGON, [np.vstack([ring, ring[:1]])])


@F.pandas_udf(T.BinaryType())
def wkb_ribbon(line: pd.Series, ratio: pd.Series, decay: pd.Series, limit: pd.Series, radius: pd.Series) -> pd.Series:
    return pd.Series([ribbon(None if g is None else bytes(g), *v) for g, *v in zip(line, ratio, decay, limit, radius, strict=True)], dtype=object)


def ribbons(segments: DataFrame, limit: float, radii: list[float]) -> DataFrame:
    """Segments (geom in metres, ratio, lat, ...) with a row for each radius: ``radius`` and the ribbon in ``geom``; those without one are left out."""
    each = segments.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    return each.withColumn("geom", wkb_ribbon("geom", "ratio", fx.decay_rate(F.col("lat")), F.lit(limit), "radius")).where("geom is not null")
