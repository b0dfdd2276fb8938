"""Files: CSV variants, hive-partitioned parquet with a cache, zip members, and GeoPackage and raster-block data sources."""

from __future__ import annotations

import io
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import geotiff, shapefile


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header; ``columns``: all as strings, any length of field, for a later try_cast."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("maxCharsPerColumn", -1)
    if columns:
        reader = reader.schema(",".join(f"`{c}` string" for c in columns))
    return reader.csv(path)


def cached_subset(spark: SparkSession, source: str, predicate: str, cache: str) -> DataFrame:
    """A filtered copy of a parquet source, written once as zstd parquet and read from there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        spark.read.parquet(source).where(predicate).write.mode("overwrite").option("compression", "zstd").parquet(cache)
    return spark.read.parquet(cache)


def read_zipped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the CSV members of zip files, with ``member``; broken archives and members are left out. An archive is one task's step."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for name in archive.namelist():
                    if name.endswith(".csv"):
                        try:
                            part = pd.read_csv(io.BytesIO(archive.read(name)), dtype=str)
                        except (ValueError, zipfile.BadZipFile):
                            continue
                        yield part.assign(member=name).reindex(columns=names)

    names = [f.split()[0] for f in schema.split(",")] + ["member"]
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, f"{schema}, member string")


def append_progress(df: DataFrame, path: str, by: str) -> None:
    """Append result rows to a partitioned progress table, from which a resumed run reads what is done."""
    df.write.mode("append").partitionBy(by).parquet(path)


def gpkg_wkb(blob: bytes | None) -> bytes | None:
    """The WKB inside a GeoPackage geometry blob."""
    if not blob or blob[:2] != b"GP":
        return None
    return blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}.get(blob[3] >> 1 & 7, 0) :]


class GeoPackage(DataSource):
    """``spark.read.format("geopackage").schema(...).option("layer", name).load(path)``: a layer's rows, its geometry as WKB in ``geom``.

    Partitions are ranges of row ids, read side by side from the same file, which all executors must reach.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "MEDIUMINT": "int", "REAL": "double", "DOUBLE": "double", "BOOLEAN": "boolean"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            geometry = self._geometry(db)
            columns = db.execute(f'pragma table_info("{self.options["layer"]}")').fetchall()
        return ",".join("geom binary" if c[1] == geometry else f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in columns)

    def _geometry(self, db: sqlite3.Connection) -> str:
        row = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", [self.options["layer"]]).fetchone()
        return row[0] if row else "geom"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LayerReader(self.options, schema)


class _LayerReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.layer, self.names = options["path"], options["layer"], schema.names
        self.parts = int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{self.layer}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((a, a + step)) for a in range(low, high + 1, step)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b = partition.value
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            row = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", [self.layer]).fetchone()
            geometry = row[0] if row else "geom"
            wanted = ",".join(f'"{geometry if n == "geom" else n}"' for n in self.names)
            for r in db.execute(f'select {wanted} from "{self.layer}" where rowid >= ? and rowid < ?', [a, b]):
                yield tuple(gpkg_wkb(v) if n == "geom" else v for n, v in zip(self.names, r, strict=True))


def write_geopackage(path: str, layer: str, names: list[str], rows: Iterator[tuple], srid: int = 4326) -> int:
    """Write rows (geometry as WKB in ``geom``) as a layer, one by one; an export for small results. Returns their number."""
    with sqlite3.connect(path) as db:
        db.execute("create table if not exists gpkg_contents (table_name text primary key, data_type text, identifier text, srs_id integer)")
        db.execute("create table if not exists gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer)")
        db.execute("insert or replace into gpkg_contents values (?, 'features', ?, ?)", [layer, layer, srid])
        db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', ?, 0, 0)", [layer, srid])
        db.execute(f'create table "{layer}" ({", ".join(f"{n} blob" if n == "geom" else n for n in names)})')
        head, n = b"GP\x00\x01" + struct.pack("<i", srid), 0
        for row in rows:
            db.execute(f'insert into "{layer}" values ({",".join("?" * len(names))})', [head + v if c == "geom" and v is not None else v for c, v in zip(names, row, strict=True)])
            n += 1
    return n


class RasterBlocks(DataSource):
    """``format("rasterblocks")``: an ESRI ASCII grid as pixels (row, col, value); partitions are ranges of rows. No-data is null."""

    @classmethod
    def name(cls) -> str:
        return "rasterblocks"

    def schema(self) -> str:
        return "row int, col int, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _GridReader(self.options)


def grid_header(path: str) -> tuple[dict[str, float], int]:
    """The header of an ASCII grid, and the number of its lines."""
    head: dict[str, float] = {}
    with open(path) as f:
        for n, line in enumerate(f):
            words = line.split()
            if len(words) != 2 or not words[0][0].isalpha():
                return head, n
            head[words[0].lower()] = float(words[1])
    return head, len(head)


class _GridReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("blockrows", 256))

    def partitions(self) -> list[InputPartition]:
        n = int(grid_header(self.path)[0]["nrows"])
        return [InputPartition((a, min(a + self.rows, n))) for a in range(0, n, self.rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        head, skip = grid_header(self.path)
        a, b = partition.value
        mark = head.get("nodata_value")
        with open(self.path) as f:
            for k, line in enumerate(f):
                row = k - skip
                if row >= b:
                    return
                if row >= a:
                    for col, word in enumerate(line.split()):
                        v = float(word)
                        yield row, col, None if v == mark or v != v else v


def write_grid(df: DataFrame, path: str, rows: int, cols: int, size: float, x0: float, y0: float, mark: float = -9999.0) -> None:
    """Pixels (row, col, value) as an ASCII grid, row by row through the driver's iterator: never all at once."""
    lines = df.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("v")).orderBy("row")
    with open(path, "w") as f:
        f.write(f"ncols {cols}\nnrows {rows}\nxllcorner {x0}\nyllcorner {y0}\ncellsize {size}\nNODATA_value {mark}\n")
        at = 0
        for r in lines.toLocalIterator():
            while at < r["row"]:
                f.write(" ".join([str(mark)] * cols) + "\n")
                at += 1
            f.write(" ".join(str(mark if (v := r["v"].get(c)) is None else v) for c in range(cols)) + "\n")
            at += 1
        for _ in range(at, rows):
            f.write(" ".join([str(mark)] * cols) + "\n")


def register(spark: SparkSession) -> None:
    """Make the data sources known to a session."""
    for source in (GeoPackage, RasterBlocks, geotiff.GeoTiff, shapefile.Shapefile):
        spark.dataSource.register(source)


def scratch(name: str) -> Path:
    """A file in a new temporary folder, for exports of small results from the driver."""
    return Path(tempfile.mkdtemp(prefix="catchwork-")) / name
