"""Windows of raster files: a data source whose partitions are runs of blocks, pruned by row and column.

    spark.dataSource.register(RasterSource)
    spark.read.format("raster_blocks").option("path", folder).load().where("cell_row between 0 and 99")

Comparisons of cell_row and cell_col with numbers are pushed down to the blocks
that can meet them; other blocks are neither planned nor read, whatever the
file's size. Files are read by ranges through ``pyarrow.fs``: local paths and
the stores it knows (s3, gs, hdfs, ...); executors need the same access.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from thalweg.operators.grid import COL, ROW, Grid
from thalweg.sources.geotiff import as_cells, decode, describe, places, shift

_PAGE = 1 << 16


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    """The path itself, or the TIFF files in a folder, in order."""
    from pyarrow import fs

    store, place = _store(path)
    if store.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and f.path.lower().endswith((".tif", ".tiff")))
    return [path.rstrip("/") + n[len(place.rstrip("/")) :] for n in names]


def _paged(file):
    """Reads of a file by pages, so that a table of tags is not fetched entry by entry."""
    pages: dict[int, bytes] = {}

    def read(at: int, size: int) -> bytes:
        if size > _PAGE:
            return file.read_at(size, at)
        out = b""
        for k in range(at // _PAGE, (at + max(1, size) - 1) // _PAGE + 1):
            if k not in pages:
                pages[k] = file.read_at(_PAGE, k * _PAGE)
            out += pages[k]
        return out[at % _PAGE : at % _PAGE + size]

    return read


@dataclass
class Run(InputPartition):
    """Blocks of one file: (first row, first column, offset, size), rows and columns of the file."""

    path: str
    info: dict
    band: int
    up: int
    left: int
    blocks: list[tuple[int, int, int, int]]


class WindowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.band = options["path"], int(options.get("band", 1))
        self.keep = str(options.get("keepnodata", options.get("keepNoData", "true"))).lower() == "true"
        self.run_bytes = int(options.get("runbytes", options.get("runBytes", 16 << 20)))
        corner = [options.get(k) for k in ("x0", "y0")]
        self.corner = tuple(map(float, corner)) if None not in corner else None
        self.low, self.high = {ROW: -math.inf, COL: -math.inf}, {ROW: math.inf, COL: math.inf}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds of rows and columns; all filters go back, as blocks reach beyond the bounds."""
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in self.low:
                c = f.attribute[0]
                values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
                if values and not isinstance(f, LessThan | LessThanOrEqual):
                    self.low[c] = max(self.low[c], min(values))
                if values and not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high[c] = min(self.high[c], max(values))
            yield f

    def partitions(self) -> list[Run]:
        runs = []
        for path in _listed(self.path):
            store, place = _store(path)
            with store.open_input_file(place) as file:
                info = describe(_paged(file))
            up, left = shift(info, Grid(*self.corner, info["dx"], info["dy"])) if self.corner else (0, 0)
            high, wide = info["block"]
            met = [
                (row, col, at, size)
                for plane, row, col, at, size in places(info)
                if (info["planar"] != 2 or plane == self.band - 1) and row + up <= self.high[ROW] and row + up + high > self.low[ROW] and col + left <= self.high[COL] and col + left + wide > self.low[COL]
            ]
            slim = {k: v for k, v in info.items() if k not in ("at", "sizes")}
            held, total = [], 0
            for block in met:
                held.append(block)
                total += block[3]
                if total >= self.run_bytes:
                    runs.append(Run(path, slim, self.band, up, left, held))
                    held, total = [], 0
            if held:
                runs.append(Run(path, slim, self.band, up, left, held))
        return runs

    def read(self, run: Run | None) -> Iterator[pa.RecordBatch]:
        if run is None:  # no block is met
            return
        store, place = _store(run.path)
        with store.open_input_file(place) as file:
            for row, col, at, size in run.blocks:
                cells = decode(file.read_at(size, at), run.info, row, col)
                band = cells[:, :, 0 if run.info["planar"] == 2 else run.band - 1]
                r, c, values, gone = as_cells(band, row + run.up, col + run.left, run.info["nodata"], self.keep)
                if len(r):
                    yield pa.record_batch([pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(values, mask=gone)], names=[ROW, COL, "value"])


class RasterSource(DataSource):
    """Options: path (a file or a folder), band, keepNoData, runBytes (packed bytes a partition), x0 and y0 of a common corner."""

    @classmethod
    def name(cls) -> str:
        return "raster_blocks"

    def schema(self) -> str:
        return f"{ROW} long, {COL} long, value double"

    def reader(self, schema) -> WindowReader:
        return WindowReader(self.options)


def read_window(spark: SparkSession, path: str, grid: Grid, xmin: float, ymin: float, xmax: float, ymax: float, band: int = 1, keep_no_data: bool = True) -> DataFrame:
    """(cell_row, cell_col, value) of the cells whose centre lies in the box, rows and columns from the grid's corner.

    Only the blocks that the box touches are read.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    cells = spark.read.format("raster_blocks").options(path=path, band=band, keepNoData=str(keep_no_data).lower(), x0=grid.x0, y0=grid.y0).load()
    r0, r1 = math.floor((grid.y0 - ymax) / grid.dy) - 1, math.floor((grid.y0 - ymin) / grid.dy) + 1
    c0, c1 = math.floor((xmin - grid.x0) / grid.dx) - 1, math.floor((xmax - grid.x0) / grid.dx) + 1
    near = cells.where((F.col(ROW) >= r0) & (F.col(ROW) <= r1) & (F.col(COL) >= c0) & (F.col(COL) <= c1))
    return near.where(grid.lon(F.col(COL)).between(xmin, xmax) & grid.lat(F.col(ROW)).between(ymin, ymax))
