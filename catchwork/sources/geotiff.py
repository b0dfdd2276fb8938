"""GeoTIFF: rasters of one band as pixels, read block by block, and pixels written as tiles compressed on the executors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Tags of the format, and the sizes and codes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIE, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
_FIELDS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
#: Side of a written tile.
TILE = 256


def tags(f: BinaryIO) -> tuple[str, dict[int, tuple]]:
    """(byte order, tag -> values) of the first image of a classic or big TIFF file."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    number, entry, inline = ("Q", 20, 8) if big else ("I", 12, 4)
    f.seek(struct.unpack(order + number, head[8:16] if big else head[4:8])[0])
    count = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
    raw, out = f.read(count * entry), {}
    for k in range(count):
        tag, field, n = struct.unpack_from(order + "HH" + number, raw, k * entry)
        if field not in _FIELDS:
            continue
        code = order + str(n) + _FIELDS[field]
        size, at = struct.calcsize(code), k * entry + entry - inline
        if size <= inline:
            data = raw[at : at + size]
        else:
            f.seek(struct.unpack_from(order + number, raw, at)[0])
            data = f.read(size)
        out[tag] = struct.unpack(code, data)
    return order, out


def unpacked_lzw(data: bytes) -> bytes:
    """Bytes of an LZW strip: codes of 9 to 12 bits, high bits first, widened a code early."""
    out, table, width, bits, held, last = [], [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last is not None:
            table.append(last + word[:1])
        last = word
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


class Raster:
    """Layout of a file: size, blocks, kind of value, place. Rasters of more than one band are refused."""

    def __init__(self, f: BinaryIO):
        self.order, t = tags(f)
        if t.get(SAMPLES, (1,))[0] != 1:
            raise ValueError("a raster of one band is wanted")
        self.width, self.height, self.compression, self.predictor = t[WIDTH][0], t[HEIGHT][0], t.get(COMPRESSION, (NONE,))[0], t.get(PREDICTOR, (1,))[0]
        if self.compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE) or self.predictor not in (1, 2):
            raise ValueError(f"compression {self.compression} with predictor {self.predictor} is not supported")
        self.kind = np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[t.get(FORMAT, (1,))[0]] + str(t.get(BITS, (8,))[0] // 8))
        tiled = TILES in t
        self.block_width = t[TILE_WIDTH][0] if tiled else self.width
        self.block_height = t[TILE_HEIGHT][0] if tiled else min(t.get(STRIP_ROWS, (self.height,))[0], self.height)
        self.offsets, self.sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
        self.across, self.tiled = -(-self.width // self.block_width), tiled
        self.mark = float(bytes(t[NO_DATA]).split(b"\0")[0]) if NO_DATA in t else None
        tie, scale = t.get(TIE, (0.0,) * 6), t.get(SCALE, (1.0, 1.0, 0.0))
        #: x and y of the upper left corner, width and height of a pixel
        self.place = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1])

    def block(self, f: BinaryIO, k: int) -> tuple[int, int, np.ndarray]:
        """(first row, first column, values) of a block, cut to the raster."""
        row, col = k // self.across * self.block_height, k % self.across * self.block_width
        rows = self.block_height if self.tiled else min(self.block_height, self.height - row)
        if not self.sizes[k]:  # a sparse file leaves empty blocks out
            v = np.full((rows, self.block_width), 0 if self.mark is None else self.mark).astype(self.kind)
        else:
            f.seek(self.offsets[k])
            data = f.read(self.sizes[k])
            data = zlib.decompress(data) if self.compression in (DEFLATE, OLD_DEFLATE) else unpacked_lzw(data) if self.compression == LZW else data
            v = np.frombuffer(data, self.kind, rows * self.block_width).reshape(rows, self.block_width)
            if self.predictor == 2:
                v = np.cumsum(v, axis=1, dtype=self.kind.newbyteorder("="))
        return row, col, v[: self.height - row, : self.width - col]


class GeoTiff(DataSource):
    """``format("geotiff")``: a raster as pixels (row, col, x, y, value), x and y those of the centre; partitions are runs of blocks.

    No-data and NaN are null. The file must be reachable by all executors; option ``blocks``: blocks of a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row int, col int, x double, y double, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BlockReader(self.options)


class _BlockReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.blocks = options["path"], int(options.get("blocks", 64))

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            n = len(Raster(f).offsets)
        return [InputPartition((a, min(a + self.blocks, n))) for a in range(0, n, self.blocks)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            r = Raster(f)
            x0, y0, dx, dy = r.place
            for k in range(*partition.value):
                row, col, v = r.block(f, k)
                rows, cols = np.repeat(np.arange(v.shape[0]) + row, v.shape[1]), np.tile(np.arange(v.shape[1]) + col, v.shape[0])
                flat = v.ravel().astype(float)
                gone = np.isnan(flat) if r.mark is None else np.isnan(flat) | (flat == np.array(r.mark, r.kind).astype(float))
                columns = [rows.astype("int32"), cols.astype("int32"), x0 + (cols + 0.5) * dx, y0 - (rows + 0.5) * dy]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(flat, mask=gone)], names=["row", "col", "x", "y", "value"])


def write_geotiff(df: DataFrame, path: str, rows: int, cols: int, size: float, x0: float, y0: float, kind: str = "f8", mark: float = -9999.0) -> None:
    """Pixels (row, col, value) as a big TIFF of tiles, LZW being read only: tiles are deflated. (x0, y0): the upper left corner.

    Tiles are made and compressed on the executors and pass the driver one partition at a time; absent pixels and nulls are no data,
    tiles without a pixel take no space. ``kind``: a numpy type as ``i4`` or ``f8``.
    """
    across, down = -(-cols // TILE), -(-rows // TILE)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.full((TILE, TILE), mark).astype("<" + kind)
        known = pdf[pdf["value"].notna()]
        v[known["row"].to_numpy() % TILE, known["col"].to_numpy() % TILE] = known["value"].to_numpy()
        return pd.DataFrame({"tile": [int(pdf["tile"].iloc[0])], "data": [zlib.compress(v.tobytes())]})

    inside = df.where((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols))
    number = F.floor(F.col("row") / TILE).cast("long") * across + F.floor(F.col("col") / TILE).cast("long")
    tiles = inside.select(number.alias("tile"), "row", "col", "value").groupBy("tile").applyInPandas(packed, "tile long, data binary")
    offsets, sizes = [0] * (across * down), [0] * (across * down)
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        for r in tiles.toLocalIterator():
            offsets[r["tile"]], sizes[r["tile"]] = f.tell(), len(r["data"])
            f.write(r["data"])
        depth, form = int(kind[1:]) * 8, {"u": 1, "i": 2, "f": 3}[kind[0]]
        text = repr(mark).encode() + b"\0"
        entries = [(WIDTH, 4, [cols]), (HEIGHT, 4, [rows]), (BITS, 3, [depth]), (COMPRESSION, 3, [DEFLATE]), (262, 3, [1]), (SAMPLES, 3, [1]), (TILE_WIDTH, 3, [TILE]), (TILE_HEIGHT, 3, [TILE]),
                   (TILES, 16, offsets), (TILE_BYTES, 16, sizes), (FORMAT, 3, [form]), (SCALE, 12, [size, size, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]), (NO_DATA, 2, list(text))]
        placed = []
        for tag, field, values in entries:
            data = struct.pack(f"<{len(values)}{_FIELDS[field]}", *values)
            if len(data) > 8:
                at = f.tell()
                f.write(data)
                data = struct.pack("<Q", at)
            placed.append(struct.pack("<HHQ", tag, field, len(values)) + data.ljust(8, b"\0"))
        at = f.tell()
        f.write(struct.pack("<Q", len(placed)) + b"".join(placed) + struct.pack("<Q", 0))
        f.seek(8)
        f.write(struct.pack("<Q", at))
