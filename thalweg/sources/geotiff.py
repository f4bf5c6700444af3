"""Raster files as tables of cells and back: GeoTIFF, classic and BigTIFF, strips or tiles, uncompressed, deflate or LZW.

``read_raster`` goes through Spark's binary source, so any store that Spark
reads will do; there each file is one task, decoded block by block, and files
are smaller than 2 GB. ``thalweg.sources.windows`` reads only the blocks that
are asked for, of files of any size. ``write_images`` keeps images as rows of a
dataset, in any store that Spark writes; ``write_raster`` writes plain files.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators.grid import COL, ROW, Grid
from thalweg.plans.scratch import partitions

# Fixed values of the format: bytes and codes of field types, tag numbers.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PLANAR, SAMPLES, PREDICTOR, FORMAT = 256, 257, 258, 259, 284, 277, 317, 339
STRIP_AT, STRIP_ROWS, STRIP_SIZE, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE = 273, 278, 279, 322, 323, 324, 325
PIXEL_SCALE, TIE_POINT, KEYS, NODATA = 33550, 33922, 34735, 42113
#: Names of cell types, as numpy says them.
CELL_TYPES = {"Byte": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Float32": "f4", "Float64": "f8"}
#: Deflate levels of the three compression names.
LEVELS = {"none": 0, "low": 2, "high": 9}


#: Reads (offset, size) of a file.
Read = Callable[[int, int], bytes]


def of_bytes(data) -> Read:
    return lambda at, size: bytes(data[at : at + size])


def read_tags(read: Read) -> tuple[str, dict[int, tuple | bytes]]:
    """Byte order and the tags of a file's first image."""
    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    if order is None:
        raise ValueError("not a TIFF file")
    unpack = lambda code, at: struct.unpack(order + code, read(at, struct.calcsize(order + code)))
    big = unpack("H", 2)[0] == 43
    word, counter, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    at = unpack(word, 8 if big else 4)[0]
    n = unpack(counter, at)[0]
    at += struct.calcsize(counter)
    inline, tags = struct.calcsize("=" + word), {}
    for place in range(at, at + n * entry, entry):
        tag, kind = unpack("HH", place)
        count = unpack(word, place + 4)[0]
        code = _TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("=" + code) * count
        value = place + 4 + inline
        if size > inline:
            value = unpack(word, value)[0]
        tags[tag] = read(value, size).rstrip(b"\0") if code == "s" else unpack(f"{count}{code}", value)
    return order, tags


def describe(data: bytes | Read) -> dict:
    """Size, type, place and NoData value of a raster file, and where its blocks stand."""
    order, t = read_tags(data if callable(data) else of_bytes(data))
    one = lambda tag, default: t.get(tag, (default,))[0]
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if kind is None:
        raise ValueError("cells are no plain numbers")
    width, height = one(WIDTH, 0), one(HEIGHT, 0)
    scale, tie = t.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), t.get(TIE_POINT, (0.0,) * 6)
    dtype = np.dtype(f"{order}{kind}{one(BITS, 1) // 8}") if one(BITS, 1) >= 8 else None
    if dtype is None:
        raise ValueError("cells of less than a byte are not read")
    name = next((n for n, c in CELL_TYPES.items() if np.dtype(c) == dtype.newbyteorder("=")), dtype.str)
    return {
        "width": width, "height": height, "bands": one(SAMPLES, 1), "type": name, "dtype": dtype, "compression": one(COMPRESSION, 1), "predictor": one(PREDICTOR, 1), "planar": one(PLANAR, 1),
        "nodata": float(t[NODATA].split()[0]) if t.get(NODATA) else None, "dx": float(scale[0]), "dy": float(scale[1]), "x0": float(tie[3] - tie[0] * scale[0]), "y0": float(tie[4] + tie[1] * scale[1]),
        "block": (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if TILE_AT in t else (min(one(STRIP_ROWS, height), height), width), "at": t.get(TILE_AT, t.get(STRIP_AT, ())), "sizes": t.get(TILE_SIZE, t.get(STRIP_SIZE, ())), "tiled": TILE_AT in t,
    }


def unpack_codes(raw: bytes) -> bytes:
    """Bytes of a block in variable-width codes (LZW): 9 to 12 bits, highest bit first, the width growing one code early."""
    clear, stop = 256, 257
    out, table, before = bytearray(), [], b""
    held = bits = at = 0
    width = 9
    while True:
        while bits < width:
            if at >= len(raw):
                return bytes(out)
            held, bits, at = (held << 8 | raw[at]) & 0xFFFFFFFF, bits + 8, at + 1
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == stop:
            return bytes(out)
        if code == clear:
            table, before, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise ValueError("codes do not begin with a clear code")
        if before:
            if code > len(table):
                raise ValueError("a code that is not there yet")
            table.append(before + (table[code] if code < len(table) else before)[:1])
        before = table[code]
        out += before
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)


def places(info: dict) -> list[tuple[int, int, int, int, int]]:
    """(plane, first row, first column, offset, size) of every block of a file."""
    if info["compression"] not in (1, 5, 8, 32946):
        raise ValueError(f"compression {info['compression']} is not read; uncompressed, deflate and LZW are")
    if info["predictor"] not in (1, 2):
        raise ValueError("the floating point predictor is not read")
    high, wide = info["block"]
    across, down = -(-info["width"] // wide), -(-info["height"] // high)
    planes = info["bands"] if info["planar"] == 2 else 1
    return [(p, k // across * high, k % across * wide, info["at"][p * across * down + k], info["sizes"][p * across * down + k]) for p in range(planes) for k in range(across * down)]


def decode(raw: bytes, info: dict, row: int, col: int) -> np.ndarray:
    """Cells (rows, columns, bands) of the block that begins at (row, col); cells beyond the image are cut off."""
    if info["compression"] == 5:
        raw = unpack_codes(raw)
    elif info["compression"] != 1:
        raw = zlib.decompress(raw)
    (high, wide), inside = info["block"], 1 if info["planar"] == 2 else info["bands"]
    rows = high if info["tiled"] else min(high, info["height"] - row)
    cells = np.frombuffer(raw, info["dtype"], rows * wide * inside).reshape(rows, wide, inside)
    if info["predictor"] == 2:
        cells = np.cumsum(cells, axis=1, dtype=info["dtype"].newbyteorder("="))
    return cells[: info["height"] - row, : info["width"] - col]


def blocks(data: bytes, info: dict) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band, first row, first column, cells) of each block."""
    for plane, row, col, at, size in places(info):
        cells = decode(bytes(data[at : at + size]), info, row, col)
        for b in range(cells.shape[2]):
            yield plane + b + 1, row, col, cells[:, :, b]


def shift(info: dict, grid: Grid | None) -> tuple[int, int]:
    """Rows and columns by which a file's corner stands below and right of the grid's."""
    return (round((grid.y0 - info["y0"]) / info["dy"]), round((info["x0"] - grid.x0) / info["dx"])) if grid else (0, 0)


def as_cells(block: np.ndarray, row: int, col: int, nodata: float | None, keep_no_data: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value, no data) of a block's cells, the block's corner at (row, col)."""
    values = np.ascontiguousarray(block).ravel().astype(np.float64)
    gone = np.isnan(values) | (values == nodata if nodata is not None else False)
    r = np.repeat(np.arange(block.shape[0]) + row, block.shape[1])
    c = np.tile(np.arange(block.shape[1]) + col, block.shape[0])
    return (r, c, values, gone) if keep_no_data else (r[~gone], c[~gone], values[~gone], gone[~gone])


def _files(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """(file, content) of files, or of the images of a dataset (``write_images``)."""
    return path.select("file", "content") if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


INFO = "file string, width long, height long, bands int, type string, nodata double, x0 double, y0 double, dx double, dy double, xmax double, ymin double, compressed boolean"


def raster_info(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """A row for each raster file: size, bands, cell type, NoData, upper left corner, cell size, lower right corner."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                i = describe(content.as_buffer())
                rows.append({**{c: i[c] for c in ("width", "height", "bands", "type", "nodata", "x0", "y0", "dx", "dy")}, "file": file, "xmax": i["x0"] + i["width"] * i["dx"], "ymin": i["y0"] - i["height"] * i["dy"], "compressed": i["compression"] != 1})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("bands", pa.int32()), ("type", pa.string()), *[(c, pa.float64()) for c in ("nodata", "x0", "y0", "dx", "dy", "xmax", "ymin")], ("compressed", pa.bool_())]))

    return _files(spark, path).mapInArrow(look, INFO)


def report_no_data(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """(Raster, NoData): the file's name and the NoData value that it states, null if it states none."""
    return raster_info(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("Raster"), F.col("nodata").alias("NoData"))


def read_raster(spark: SparkSession, path: str | list[str] | DataFrame, grid: Grid | None = None, band: int = 1, keep_no_data: bool = True) -> DataFrame:
    """(cell_row, cell_col, value) of raster files; NoData is null, or left out.

    With ``grid`` rows and columns count from its corner, so that the tiles of
    a mosaic share them; else from each file's own.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer()
                info = describe(data)
                up, left = shift(info, grid)
                for b, row, col, block in blocks(data, info):
                    if b != band:
                        continue
                    r, c, values, gone = as_cells(block, row + up, col + left, info["nodata"], keep_no_data)
                    if len(r):
                        yield pa.record_batch([pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(values, mask=gone)], names=[ROW, COL, "value"])

    return _files(spark, path).select("content").mapInArrow(cells, f"{ROW} long, {COL} long, value double")


def image(cells: np.ndarray, x0: float, y0: float, dx: float, dy: float, nodata: float | None = None, compression: str = "low", block: int = 256) -> bytes:
    """A tiled GeoTIFF in geographic coordinates of a two-dimensional array."""
    if compression not in LEVELS:
        raise ValueError(f"compression is one of {sorted(LEVELS)}")
    cells = np.ascontiguousarray(cells).astype(cells.dtype.newbyteorder("<"))
    height, width = cells.shape
    parts = []
    for row in range(0, height, block):
        for col in range(0, width, block):
            tile = np.zeros((block, block), cells.dtype)
            piece = cells[row : row + block, col : col + block]
            tile[: piece.shape[0], : piece.shape[1]] = piece
            parts.append(zlib.compress(tile.tobytes(), LEVELS[compression]) if LEVELS[compression] else tile.tobytes())
    sizes = [len(p) for p in parts]
    starts = [8 + sum(sizes[:k]) for k in range(len(sizes))]
    if starts[-1] + sizes[-1] >= 1 << 32:
        raise ValueError("too large for one file")
    kind = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
    tags = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8 * cells.dtype.itemsize]), (COMPRESSION, "H", [8 if LEVELS[compression] else 1]), (262, "H", [1]), (SAMPLES, "H", [1]), (PLANAR, "H", [1]),
        (TILE_WIDTH, "I", [block]), (TILE_HEIGHT, "I", [block]), (TILE_AT, "I", starts), (TILE_SIZE, "I", sizes), (FORMAT, "H", [kind]), (PIXEL_SCALE, "d", [dx, dy, 0.0]), (TIE_POINT, "d", [0.0, 0.0, 0.0, x0, y0, 0.0]),
        (KEYS, "H", [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326]), *([(NODATA, "s", f"{nodata:.17g}".encode() + b"\0")] if nodata is not None else []),
    ]
    codes = {c: k for k, c in _TYPES.items() if k not in (1, 7)}
    at, extra, entries = starts[-1] + sizes[-1], b"", []
    at += at % 2
    table = at
    after = table + 2 + 12 * len(tags) + 4
    for tag, code, values in tags:
        raw = values if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        where = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", after + len(extra))
        if len(raw) > 4:
            extra += raw + b"\0" * (len(raw) % 2)
        entries.append(struct.pack("<HHI", tag, codes[code], len(values)) + where)
    body = struct.pack("<2sHI", b"II", 42, table) + b"".join(parts)
    return body.ljust(table, b"\0") + struct.pack("<H", len(tags)) + b"".join(entries) + struct.pack("<I", 0) + extra


def images(cells: DataFrame, grid: Grid, type: str = "Int32", nodata: float = -9999.0, compression: str = "low", size: int = 2048, name: str = "raster") -> DataFrame:
    """(file, cells, content): cells as GeoTIFF images of ``size`` x ``size`` cells.

    Images begin at multiples of ``size`` from the grid's corner; what no cell
    covers is NoData. A task holds one image's cells at a time.
    """
    if type not in CELL_TYPES:
        raise ValueError(f"type is one of {sorted(CELL_TYPES)}")
    spark = cells.sparkSession
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    dealt = cells.where("value is not null").select(at(ROW).alias("_r"), at(COL).alias("_c"), F.col(ROW).cast("long").alias(ROW), F.col(COL).cast("long").alias(COL), F.col("value").cast("double").alias("value"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, n = None, None, 0

        def close() -> pa.RecordBatch:
            data = image(held, grid.x0 + now[1] * size * grid.dx, grid.y0 - now[0] * size * grid.dy, grid.dx, grid.dy, nodata, compression)
            return pa.record_batch([pa.array([f"{name}_r{now[0]:04d}c{now[1]:04d}.tif"]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["file", "cells", "content"])

        for batch in batches:
            r, c, row, col, value = (batch.column(k).to_numpy() for k in ("_r", "_c", ROW, COL, "value"))
            change = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])])) if len(r) else []
            for a, e in zip(change, [*change[1:], len(r)], strict=True):
                if now != (int(r[a]), int(c[a])):
                    if now is not None:
                        yield close()
                    now, n = (int(r[a]), int(c[a])), 0
                    held = np.full((size, size), nodata, CELL_TYPES[type])
                held[row[a:e] - now[0] * size, col[a:e] - now[1] * size] = value[a:e]
                n += int(e - a)
        if now is not None:
            yield close()

    return dealt.repartition(partitions(spark), "_r", "_c").sortWithinPartitions("_r", "_c").mapInArrow(make, "file string, cells long, content binary")


def write_images(cells: DataFrame, path: str, grid: Grid, **how) -> DataFrame:
    """``images`` as rows of a Parquet dataset, in any store that Spark writes; gives the dataset."""
    images(cells, grid, **how).write.option("compression", "none").parquet(path)
    return cells.sparkSession.read.schema("file string, cells long, content binary").parquet(path)


def write_raster(cells: DataFrame, folder: str, grid: Grid, type: str = "Int32", nodata: float = -9999.0, compression: str = "low", size: int = 2048, name: str = "raster") -> DataFrame:
    """``images`` as plain files in a folder that all executors have mounted; gives (file, cells).

    A file is written aside and renamed, so a task that runs twice does no harm.
    """
    made = images(cells, grid, type, nodata, compression, size, name)
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [f"{folder}/{f}" for f in batch.column("file").to_pylist()]
            for file, content in zip(files, batch.column("content"), strict=True):
                with open(f"{file}.{os.getpid()}.part", "wb") as f:
                    f.write(content.as_buffer())
                os.replace(f"{file}.{os.getpid()}.part", file)
            yield pa.record_batch([pa.array(files), batch.column("cells")], names=["file", "cells"])

    return made.mapInArrow(write, "file string, cells long")
