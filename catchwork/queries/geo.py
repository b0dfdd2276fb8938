"""Projections, tiles, boxes and ring measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as g
from ..operators.kernel import wkb_area, wkb_box, wkb_centroid
from .base import SITES, Registry, r4, sites

query = Registry()
_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)
_ZONE = "least(cast(floor((x + 180) / 6) as int) + 1, 60)"
_EPSG = f"(case when y >= 0 then 32600 else 32700 end + {_ZONE})"


@query(f"select pid, {_EPSG}::int epsg from {SITES}")
def i11_utm_epsg(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).select("pid", g.utm_epsg(F.col("x"), F.col("y")).alias("epsg"))


@query(f"select pid, case when y * 1.5 between -80 and 84 then {_EPSG} else 3857 end::int epsg from {SITES}")
def i12_utm_epsg_fallback(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).select("pid", g.utm_epsg(F.col("x"), F.col("y") * 1.5).alias("epsg"))


def _utm_sql() -> str:
    a = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
    rect = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
    e = 2 * _N**0.5 / (1 + _N)
    x = " + ".join(["eta", *[f"{c!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(a, 1)]])
    y = " + ".join(["xi", *[f"{c!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(a, 1)]])
    return f"""with z as (select pid, radians(y) phi, radians(x) - radians({_ZONE} * 6.0 - 183.0) lam, y from {SITES}),
      t as (select *, sinh(atanh(sin(phi)) - {e!r}::double * atanh({e!r}::double * sin(phi))) t from z),
      w as (select *, atan2(t, cos(lam)) xi, atanh(sin(lam) / sqrt(1 + t * t)) eta from t)
      select pid, round(500000 + 0.9996 * {rect!r}::double * ({x}), 3) easting, round(case when y >= 0 then 0 else 10000000 end + 0.9996 * {rect!r}::double * ({y}), 3) northing from w"""


@query(_utm_sql())
def i14_utm_projection(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d).withColumn("epsg", g.utm_epsg(F.col("x"), F.col("y")))
    e, n = g.utm_xy(F.col("x"), F.col("y"), F.col("epsg"))
    return s.select("pid", r4(e, 3).alias("easting"), r4(n, 3).alias("northing"))


@query(f"select pid, round(radians(x) * 6378137, 3) mx, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137, 3) my from {SITES}")
def i15_web_mercator(spark: SparkSession, d: str) -> DataFrame:
    x, y = g.mercator_xy(F.col("x"), F.col("y"))
    return sites(spark, d).select("pid", r4(x, 3).alias("mx"), r4(y, 3).alias("my"))


@query(f"""select pid, cast(round_even((case when dx > 20037508.342789244 then dx - 40075016.68557849 when dx < -20037508.342789244 then dx + 40075016.68557849 else dx end) * (512 / 10000000.0::double) + 256, 0) as int) px,
    cast(round_even((1000000 - my) * (512 / 10000000.0::double) + 256, 0) as int) py from (select pid, radians(x) * 6378137 - 15000000 dx, ln(tan(pi() / 4 + radians(y) / 2)) * 6378137 my from {SITES})""")
def i16_mercator_pixel(spark: SparkSession, d: str) -> DataFrame:
    x, y = g.mercator_xy(F.col("x"), F.col("y"))
    px, py = g.mercator_pixel(x, y, F.lit(15_000_000.0), F.lit(1_000_000.0), 512, 10_000_000.0)
    return sites(spark, d).select("pid", px.alias("px"), py.alias("py"))


_TX = "least(greatest(cast(floor(({}) / 360.0 * 256) as int), 0), 255)"
_TY = "least(greatest(cast(floor((1.0 - asinh(tan(radians({}))) / pi()) / 2.0 * 256) as int), 0), 255)"


@query(f"""select pid, tx || '-' || ty || '-8' tile from (select pid, unnest(generate_series({_TX.format('x - 1 + 180')}, {_TX.format('x + 1 + 180')})) tx, y0, y1 from (select pid, x, {_TY.format('y + 1')} y0, {_TY.format('y - 1')} y1 from {SITES})) a, lateral (select unnest(generate_series(y0, y1)) ty) b""")
def i18_tiles_of_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = g.box_around(F.col("x"), F.col("y"), 1.0)
    return sites(spark, d).select("pid", F.explode(g.tiles_of_box(*b, 8)).alias("tile"))


@query(f"""select pid, round(tx / 256.0 * 360 - 180, 6) minx, round(degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 256.0::double)))), 6) miny, round((tx + 1) / 256.0 * 360 - 180, 6) maxx, round(degrees(atan(sinh(pi() * (1 - 2 * ty / 256.0::double)))), 6) maxy from (select pid, {_TX.format('x + 180')} tx, {_TY.format('y')} ty from {SITES})""")
def i18_tile_boxes(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat_ws("-", g.tile_x(F.col("x"), 8).cast("string"), g.tile_y(F.col("y"), 8).cast("string"), F.lit("8"))
    box = g.tile_box(t)
    return sites(spark, d).select("pid", *[r4(c, 6).alias(n) for n, c in zip(("minx", "miny", "maxx", "maxy"), box, strict=True)])


@query(f"select pid, round(degrees(atan2(y + pid % 7 - 3 - y, x + pid % 5 - 2 - x)), 4) angle from {SITES}")
def i10_line_angles(spark: SparkSession, d: str) -> DataFrame:
    x, y, p = F.col("x"), F.col("y"), F.col("pid")
    return sites(spark, d).select("pid", r4(g.line_angle(x, y, x + p % 5 - 2, y + p % 7 - 3)).alias("angle"))


@query(f"select pid, round(x + (pid % 4 + 1) / 2.0, 6) cx, round(y + (pid % 3 + 1) / 2.0, 6) cy, ((pid % 4 + 1) * (pid % 3 + 1))::double area from {SITES}")
def i3_i9_ring_measures(spark: SparkSession, d: str) -> DataFrame:
    x, y, w, h = F.col("x"), F.col("y"), F.col("pid") % 4 + 1, F.col("pid") % 3 + 1
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    ring = F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))
    c = g.ring_centroid(F.col("ring"))
    return sites(spark, d).select("pid", ring.alias("ring")).select("pid", r4(c["x"], 6).alias("cx"), r4(c["y"], 6).alias("cy"), r4(g.ring_area(F.col("ring")), 6).alias("area"))


@query(f"select pid, round(x + (pid % 4 + 1) / 2.0, 6) cx, round(y + (pid % 3 + 1) / 2.0, 6) cy, ((pid % 4 + 1) * (pid % 3 + 1))::double area from {SITES}")
def i3_wkb_measures(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    s = sites(spark, d).select("pid", wkb_box(x, y, x + F.col("pid") % 4 + 1, y + F.col("pid") % 3 + 1).alias("geom"))
    return s.select("pid", wkb_centroid("geom").alias("c"), wkb_area("geom").alias("a")).select("pid", r4("c.x", 6).alias("cx"), r4("c.y", 6).alias("cy"), r4("a", 6).alias("area"))
