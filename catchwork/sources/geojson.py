"""GeoJSON and Overpass JSON: features to rows with well-known binary, and back."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import kernel

_KINDS = {"Point": kernel.POINT, "LineString": kernel.LINE, "Polygon": kernel.POLYGON, "MultiPoint": kernel.MULTIPOINT, "MultiLineString": kernel.MULTILINE, "MultiPolygon": kernel.MULTIPOLYGON}


def to_wkb(geometry: str | None) -> bytes | None:
    """WKB of a GeoJSON geometry; None for null, broken or unknown ones."""
    try:
        g = json.loads(geometry or "null")
        return kernel.dumps(_KINDS[g["type"]], g["coordinates"])
    except (TypeError, KeyError, ValueError, AttributeError):
        return None


def to_geometry(data: bytes | None) -> str | None:
    """GeoJSON geometry of a WKB value."""
    v = kernel.loads(data)
    if v is None:
        return None

    def plain(p):
        return p.tolist() if isinstance(p, np.ndarray) else [plain(q) for q in p] if isinstance(p, list) else p

    return json.dumps({"type": next(n for n, k in _KINDS.items() if k == v[0]), "coordinates": plain(v[1])})


@F.pandas_udf(T.BinaryType())
def geometry_wkb(g: pd.Series) -> pd.Series:
    return g.map(to_wkb)


@F.pandas_udf(T.StringType())
def wkb_geometry(g: pd.Series) -> pd.Series:
    return g.map(to_geometry)


def read_geojson(spark: SparkSession, path: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Features of GeoJSON files (a path or glob): their properties, ``geom`` as WKB and ``file``.

    ``properties`` names the wanted ones and their types; without it each feature's properties come as one map. A file is a
    JSON document, so a file is one task; many files are read side by side.
    """
    geometry = "struct<type:string,coordinates:string>"
    wanted = ",".join(f"`{n}`:{t}" for n, t in properties.items()) if properties else ""
    kind = f"struct<{wanted}>" if properties else "map<string,string>"
    raw = spark.read.schema(f"features array<struct<properties:{kind},geometry:{geometry}>>").json(path, multiLine=True)
    rows = raw.select(F.explode("features").alias("f"), F.col("_metadata.file_name").alias("file"))
    whole = F.when(F.col("f.geometry").isNotNull(), F.format_string('{"type":"%s","coordinates":%s}', "f.geometry.type", "f.geometry.coordinates"))
    return rows.select(*([f"f.properties.`{n}`" for n in properties] if properties else ["f.properties"]), geometry_wkb(whole).alias("geom"), "file")


def write_geojson(df: DataFrame, path: str, geom: str = "geom") -> None:
    """One feature a line (newline-delimited GeoJSON), in parallel."""
    own = F.struct(*[c for c in df.columns if c != geom])
    line = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(own), F.lit(',"geometry":'), F.coalesce(wkb_geometry(geom), F.lit("null")), F.lit("}"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_feature_collection(df: DataFrame, path: str, geom: str = "geom") -> int:
    """One FeatureCollection file, an export for small results: lines come through the driver's iterator. Returns their number."""
    own = F.struct(*[c for c in df.columns if c != geom])
    lines, n = df.select(F.to_json(own).alias("p"), F.coalesce(wkb_geometry(geom), F.lit("null")).alias("g")), 0
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for r in lines.toLocalIterator():
            f.write(f'{"," if n else ""}{{"type":"Feature","properties":{r["p"] or "{}"},"geometry":{r["g"]}}}')
            n += 1
        f.write("]}")
    return n


def geojson_to_parquet(spark: SparkSession, path: str, out: str, properties: dict[str, str] | None = None, overwrite: bool = False) -> DataFrame:
    """GeoJSON files (a path or glob) as Parquet, written once unless ``overwrite``; absent properties are null."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
    if overwrite or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        read_geojson(spark, path, properties).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


#: Schema of an Overpass document.
OVERPASS = "elements array<struct<type:string,id:bigint,lon:double,lat:double,nodes:array<bigint>,tags:map<string,string>,members:array<struct<type:string,ref:bigint,role:string>>>>"


def overpass_ways(raw: DataFrame) -> DataFrame:
    """Ways and relations of Overpass documents as rings: (id, tags, ring, polygon).

    ring is an array of structs x, y in node order; nodes that are missing are left out. A closed way of four nodes or more is a
    polygon, another a line; a relation is its first outer member's ring.
    """
    items = raw.select(F.explode("elements").alias("e")).select("e.*")
    nodes = items.where("type = 'node'").select(F.col("id").alias("ref"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p")).dropDuplicates(["ref"])
    ways = items.where("type = 'way'").select("id", "tags", "nodes").dropDuplicates(["id"])
    steps = ways.select("id", F.posexplode("nodes").alias("at", "ref")).join(nodes, "ref")
    ring = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("s")).select("id", F.transform("s", lambda s: s["p"]).alias("ring"))
    closed = (F.size("nodes") >= 4) & (F.get("nodes", F.lit(0)) == F.element_at("nodes", -1))
    lines = ways.join(ring, "id").select("id", "tags", "ring", closed.alias("polygon"))
    outer = F.get(F.filter("members", lambda m: (m["role"] == "outer") & (m["type"] == "way")), F.lit(0))["ref"]
    relations = items.where("type = 'relation'").select(F.col("id").alias("rid"), F.col("tags").alias("rtags"), outer.alias("ref")).where("ref is not null")
    whole = relations.join(lines.select(F.col("id").alias("ref"), "ring"), "ref").select(F.col("rid").alias("id"), F.col("rtags").alias("tags"), "ring", F.lit(True).alias("polygon"))
    return lines.unionByName(whole)


def overpass_request(tags: list[tuple[str, str]], bbox: str, timeout: int = 180) -> str:
    """The text of an Overpass query for tag filters in a box ``south,west,north,east``; a key may recur."""
    parts = "".join(f'{kind}["{k}"="{v}"]({bbox});' for k, v in tags for kind in ("node", "way", "relation"))
    return f"[out:json][timeout:{timeout}];({parts});(._;>;);out body;"


def newest(files: DataFrame) -> DataFrame:
    """(country, path, year): the newest file of each country."""
    w = Window.partitionBy("country").orderBy(F.desc("year"), "path")
    return files.where("year is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

