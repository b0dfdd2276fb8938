"""Shapefiles: records with their geometry as well-known binary, read by ranges of the index."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators import kernel


def shape_wkb(content: bytes) -> bytes | None:
    """WKB, in two dimensions, of a record's content; None for null, broken and other shapes.

    Rings that run clockwise are outer ones; a hole belongs to the smallest outer ring that holds its first point.
    """
    try:
        kind = struct.unpack_from("<i", content)[0] % 10
        if kind == 1:
            return kernel.dumps(kernel.POINT, list(struct.unpack_from("<2d", content, 4)))
        if kind == 8:
            n = struct.unpack_from("<i", content, 36)[0]
            return kernel.dumps(kernel.MULTIPOINT, np.frombuffer(content, "<f8", 2 * n, 40).reshape(n, 2).tolist())
        if kind not in (3, 5):
            return None
        parts, n = struct.unpack_from("<2i", content, 36)
        starts = [*struct.unpack_from(f"<{parts}i", content, 44), n]
        points = np.frombuffer(content, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    except (struct.error, ValueError):
        return None
    paths = [points[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]
    if not paths:
        return None
    if kind == 3:
        return kernel.dumps(kernel.LINE, paths[0]) if len(paths) == 1 else kernel.dumps(kernel.MULTILINE, paths)
    outer = [[p] for p in paths if kernel.ring_area(p) <= 0]
    if not outer:  # a file that turns its rings the other way
        outer = [[p] for p in paths]
    else:
        for hole in (p for p in paths if kernel.ring_area(p) > 0):
            around = [o for o in outer if kernel.contains(o[:1], hole[:1, 0], hole[:1, 1])[0]]
            min(around, key=lambda o: abs(kernel.ring_area(o[0]))).append(hole) if around else outer.append([hole])
    return kernel.dumps(kernel.POLYGON, outer[0]) if len(outer) == 1 else kernel.dumps(kernel.MULTIPOLYGON, outer)


def _beside(path: str, suffix: str) -> str:
    return str(Path(path).with_suffix(suffix))


class _Table:
    """The attribute table: fixed places of fields in records of a fixed length."""

    def __init__(self, path: str):
        self.path = _beside(path, ".dbf")
        with open(self.path, "rb") as f:
            head = f.read(32)
            self.rows, self.start, self.length = struct.unpack_from("<IHH", head, 4)
            raw, at, self.fields = f.read(self.start - 32), 1, {}
        for k in range(0, len(raw) - 31, 32):
            if raw[k] == 0x0D:
                break
            name, kind, size, digits = raw[k : k + 11].split(b"\0")[0].decode("latin-1"), chr(raw[k + 11]), raw[k + 16], raw[k + 17]
            self.fields[name] = (at, size, "boolean" if kind == "L" else "bigint" if kind == "N" and not digits and size < 19 else "double" if kind in "NF" else "string")
            at += size

    def value(self, record: bytes, name: str, encoding: str):
        at, size, kind = self.fields[name]
        text = record[at : at + size].decode(encoding, "replace").strip(" \0")
        if not text or set(text) == {"*"}:
            return None
        try:
            return text if kind == "string" else {"T": True, "Y": True, "F": False, "N": False}.get(text.upper()) if kind == "boolean" else int(text) if kind == "bigint" else float(text)
        except ValueError:
            return None


class Shapefile(DataSource):
    """``format("shapefile").load("x.shp")``: attributes, and the geometry as WKB in ``geom``; a schema with fewer columns reads only those.

    Options: ``encoding`` of the attributes (UTF-8), ``partitions``. The index (.shx) and table (.dbf) lie beside the file, which all executors must reach; deleted
    records are left out, and what can't be read as its field's type is null.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return ",".join([*[f"`{n}` {k}" for n, (_, _, k) in _Table(self.options["path"]).fields.items()], "geom binary"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RecordReader(self.options, schema)


class _RecordReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.parts, self.encoding = int(options.get("partitions", 8)), options.get("encoding", "utf-8")

    def partitions(self) -> list[InputPartition]:
        n = (Path(_beside(self.path, ".shx")).stat().st_size - 100) // 8
        step = max(1, -(-n // self.parts))
        return [InputPartition((a, min(a + step, n))) for a in range(0, n, step)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b = partition.value
        table = _Table(self.path)
        with open(_beside(self.path, ".shx"), "rb") as index, open(self.path, "rb") as shapes, open(table.path, "rb") as rows:
            index.seek(100 + 8 * a)
            rows.seek(table.start + table.length * a)
            for _ in range(a, b):
                offset, size = struct.unpack(">2i", index.read(8))
                record = rows.read(table.length)
                if record[:1] == b"*":
                    continue
                geom = None
                if "geom" in self.names:
                    shapes.seek(2 * offset + 8)
                    geom = shape_wkb(shapes.read(2 * size))
                yield tuple(geom if n == "geom" else table.value(record, n, self.encoding) for n in self.names)
