import json
import struct
import zipfile

import numpy as np
from pyspark.sql import functions as F

from catchwork.operators import kernel
from catchwork.sources import files, geojson, geotiff


def test_geojson_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"k": 1, "name": "a"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}, {"type": "Feature", "properties": {"k": 2}, "geometry": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    df = geojson.read_geojson(spark, str(tmp_path / "a.geojson"), {"k": "bigint", "name": "string"})
    rows = sorted(df.collect(), key=lambda r: r["k"])
    assert kernel.loads(rows[0]["geom"]) == (kernel.POINT, [1.5, 2.5]) and rows[1]["geom"] is None and rows[0]["file"] == "a.geojson"
    geojson.write_geojson(df, str(tmp_path / "out"))
    features = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {f["properties"]["k"]: f["geometry"] for f in features} == {1: {"type": "Point", "coordinates": [1.5, 2.5]}, 2: None}


def test_overpass_rings(spark, tmp_path):
    nodes = [{"type": "node", "id": i, "lon": float(x), "lat": float(y)} for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1)], 1)]
    ways = [{"type": "way", "id": 10, "nodes": [1, 2, 3, 1], "tags": {"man_made": "works"}}, {"type": "way", "id": 11, "nodes": [1, 99, 2]}]
    rel = [{"type": "relation", "id": 20, "tags": {"a": "b"}, "members": [{"type": "way", "ref": 11, "role": "inner"}, {"type": "way", "ref": 10, "role": "outer"}]}, {"type": "relation", "id": 21, "members": []}]
    (tmp_path / "o.json").write_text(json.dumps({"elements": nodes + ways + rel}))
    got = {r["id"]: r for r in geojson.overpass_ways(spark.read.schema(geojson.OVERPASS).json(str(tmp_path / "o.json"))).collect()}
    assert set(got) == {10, 11, 20} and got[10]["polygon"] and not got[11]["polygon"]
    assert [(p["x"], p["y"]) for p in got[11]["ring"]] == [(0, 0), (1, 0)] and len(got[20]["ring"]) == 4
    assert 'way["waterway"="river"]' in geojson.overpass_request([("waterway", "river"), ("waterway", "canal")], "1,2,3,4")


def test_geopackage_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    rows = [(k, kernel.dumps(kernel.POINT, (float(k), 0.0))) for k in range(10)] + [(10, None)]
    assert files.write_geopackage(path, "sites", ["idx", "geom"], iter(rows)) == 11
    files.register(spark)
    df = spark.read.format("geopackage").option("layer", "sites").schema("idx bigint, geom binary").load(path)
    assert sorted((r["idx"], None if r["geom"] is None else kernel.loads(r["geom"])[1][0]) for r in df.collect())[:3] == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_raster_blocks_round_trip(spark, tmp_path):
    path = str(tmp_path / "g.asc")
    files.write_grid(spark.createDataFrame([(0, 0, 1.0), (2, 1, 5.0)], "row int, col int, value double"), path, 3, 2, 1.0, 0.0, 0.0)
    files.register(spark)
    df = spark.read.format("rasterblocks").option("blockrows", 2).load(path)
    assert df.count() == 6 and {(r["row"], r["col"]): r["value"] for r in df.where("value is not null").collect()} == {(0, 0): 1.0, (2, 1): 5.0}


def test_zipped_csv_skips_broken_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("12.csv", "k,v\n1,x\n")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = files.read_zipped_csv(spark, str(tmp_path), "k string, v string").collect()
    assert [tuple(r) for r in got] == [("1", "x", "12.csv")]


def test_cached_subset_and_csv(spark, tmp_path, sf):
    df = files.cached_subset(spark, f"{sf}/nation.parquet", "n_regionkey = 1", str(tmp_path / "c"))
    assert df.count() == files.cached_subset(spark, "/nowhere", "true", str(tmp_path / "c")).count() > 0
    (tmp_path / "l.csv").write_bytes("k;é\n".encode("latin-1").replace(b";", b",") + "1,é\n".encode("latin-1"))
    row = files.read_csv(spark, str(tmp_path / "l.csv"), ["k", "v"], "ISO-8859-1").select(F.col("k").try_cast("bigint").alias("k"), "v").first()
    assert tuple(row) == (1, "é")


def test_newest_file(spark):
    df = spark.createDataFrame([("a", "x", 2019), ("a", "y", 2021), ("b", "z", None)], "country string, path string, year int")
    assert [tuple(r) for r in geojson.newest(df).collect()] == [("a", "y", 2021)]


def test_feature_collection_and_parquet_copy(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", kernel.dumps(kernel.POINT, [1.5, 2.5])), (2, None, None)], "k long, name string, geom binary")
    assert geojson.write_feature_collection(df, str(tmp_path / "c.geojson")) == 2
    got = geojson.geojson_to_parquet(spark, str(tmp_path / "c.geojson"), str(tmp_path / "c"), {"k": "bigint", "name": "string", "grid": "string"})
    assert sorted((r["k"], r["name"], r["grid"], r["geom"] is None) for r in got.collect()) == [(1, "a", None, False), (2, None, None, True)]
    assert geojson.geojson_to_parquet(spark, "/nowhere", str(tmp_path / "c")).count() == 2
    assert geojson.write_feature_collection(df.limit(0), str(tmp_path / "n.geojson")) == 0 and json.loads((tmp_path / "n.geojson").read_text())["features"] == []


def lzw(data):
    """Codes of a plain LZW writer, packed high bits first: codes widen when entries 511, 1023 and 2047 are made, as the format says."""
    codes, table, word = [(256, 9)], {bytes([k]): k for k in range(256)}, b""
    wide = lambda: 9 + (len(table) + 2 >= 512) + (len(table) + 2 >= 1024) + (len(table) + 2 >= 2048)
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        codes.append((table[word], wide()))
        table[word + bytes([byte])] = len(table) + 2
        word = bytes([byte])
        if len(table) + 2 >= 4094:
            codes.append((256, wide()))
            table = {bytes([k]): k for k in range(256)}
    codes += [(table[word], wide())]
    table[b"-last"] = 0
    bits = "".join(format(c, f"0{w}b") for c, w in [*codes, (257, wide())])
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_lzw():
    rng = np.random.default_rng(1)
    for data in (b"aaaaaaaaaaaaaaaaaaaaaaa", bytes(rng.integers(0, 256, 20_000).astype("u1")), bytes(rng.integers(0, 3, 60_000).astype("u1"))):
        assert geotiff.unpacked_lzw(lzw(data)) == data


def test_geotiff_round_trip(spark, tmp_path):
    path, rng = str(tmp_path / "r.tif"), np.random.default_rng(2)
    want = {(int(r), int(c)): float(v) for r, c, v in zip(rng.integers(0, 300, 500), rng.integers(0, 700, 500), rng.integers(-50, 50, 500), strict=True)}
    df = spark.createDataFrame([(*k, v) for k, v in want.items()] + [(5000, 0, 1.0), (-1, 0, 1.0)], "row int, col int, value double").where("not (row = 7 and col = 7)")
    geotiff.write_geotiff(df, path, 300, 700, 0.5, 10.0, 20.0, kind="i4", mark=-9999.0)
    files.register(spark)
    got = spark.read.format("geotiff").option("blocks", 2).load(path)
    assert got.count() == 300 * 700
    known = got.where("value is not null").collect()
    assert {(r["row"], r["col"]): r["value"] for r in known} == {k: v for k, v in want.items() if k != (7, 7)}
    assert all(r["x"] == 10 + (r["col"] + 0.5) * 0.5 and r["y"] == 20 - (r["row"] + 0.5) * 0.5 for r in known)
    geotiff.write_geotiff(df.limit(0), path, 3, 2, 1.0, 0.0, 0.0)
    assert spark.read.format("geotiff").load(path).where("value is null").count() == 6


def test_geotiff_of_strips(spark, tmp_path):
    """A classic file, big-endian, of LZW strips with differences along rows."""
    v = np.arange(35, dtype=">u2").reshape(7, 5) * 3
    diff = np.diff(v.astype("i8"), axis=1, prepend=0).astype(">u2")
    strips = [lzw(diff[k : k + 3].tobytes()) for k in range(0, 7, 3)]
    body, at = b"", 8
    offsets = []
    for s in strips:
        offsets.append(at + len(body))
        body += s
    tables = at + len(body)
    body += struct.pack(">3I3I", *offsets, *map(len, strips))
    entries = [(256, 4, 1, 5), (257, 4, 1, 7), (258, 3, 1, 16 << 16), (259, 3, 1, 5 << 16), (273, 4, 3, tables), (277, 3, 1, 1 << 16), (278, 4, 1, 3), (279, 4, 3, tables + 12), (317, 3, 1, 2 << 16)]
    head = struct.pack(">2sHI", b"MM", 42, 8 + len(body))
    (tmp_path / "s.tif").write_bytes(head + body + struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + b"\0" * 4)
    files.register(spark)
    got = {(r["row"], r["col"]): r["value"] for r in spark.read.format("geotiff").load(str(tmp_path / "s.tif")).collect()}
    assert got == {(r, c): float(v[r, c]) for r in range(7) for c in range(5)}


def shapes(tmp_path, records, fields, rows):
    """A shapefile of (type, content) records and rows of texts; fields are (name, type, length, decimals)."""
    shp, shx, at = b"", b"", 50
    for k, content in enumerate(records):
        shp += struct.pack(">2i", k + 1, len(content) // 2) + content
        shx += struct.pack(">2i", at, len(content) // 2)
        at += 4 + len(content) // 2
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + shp)
    (tmp_path / "a.shx").write_bytes(b"\0" * 100 + shx)
    head = struct.pack("<4xIHH20x", len(rows), 32 + 32 * len(fields) + 1, 1 + sum(f[2] for f in fields))
    head += b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([size, digits]) + b"\0" * 14 for n, t, size, digits in fields) + b"\r"
    body = b"".join(flag + b"".join(v.encode().ljust(f[2]) for v, f in zip(values, fields, strict=True)) for flag, values in rows)
    (tmp_path / "a.dbf").write_bytes(head + body)
    return str(tmp_path / "a.shp")


def test_shapefile(spark, tmp_path):
    ring = lambda a, b, turn: np.array([(a, a), (a, b), (b, b), (b, a), (a, a)][::turn], "<f8")
    poly = lambda *rs: struct.pack("<i32x2i", 5, len(rs), 5 * len(rs)) + struct.pack(f"<{len(rs)}i", *[5 * k for k in range(len(rs))]) + b"".join(r.tobytes() for r in rs)
    records = [struct.pack("<i2d", 1, 3.0, 4.0), poly(ring(0, 4, 1), ring(1, 2, -1), ring(10, 12, 1)), struct.pack("<i", 0), struct.pack("<i2d", 1, 0.0, 0.0), struct.pack("<i32x2ii4d", 3, 1, 2, 0, 0.0, 0.0, 1.0, 1.0)]
    rows = [(b" ", ["1", "a", "1.5", "T"]), (b" ", ["2", "b", "", "f"]), (b" ", ["x", "", "***", "?"]), (b"*", ["4", "gone", "1", "T"]), (b" ", ["5", "e", "2", "N"])]
    path = shapes(tmp_path, records, [("id", "N", 4, 0), ("name", "C", 6, 0), ("v", "N", 5, 2), ("ok", "L", 1, 0)], rows)
    files.register(spark)
    got = spark.read.format("shapefile").option("partitions", 3).load(path).collect()
    assert [tuple(r)[:4] for r in got] == [(1, "a", 1.5, True), (2, "b", None, False), (None, None, None, None), (5, "e", 2.0, False)]
    assert kernel.loads(got[0]["geom"]) == (kernel.POINT, [3.0, 4.0]) and got[2]["geom"] is None and kernel.loads(got[3]["geom"])[0] == kernel.LINE
    assert kernel.loads(got[1]["geom"])[0] == kernel.MULTIPOLYGON and kernel.area(got[1]["geom"]) == 16 - 1 + 4
    assert spark.read.format("shapefile").schema("name string").load(path).columns == ["name"]
