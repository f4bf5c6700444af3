"""GeoPackage layers through Spark's Python data source interface; a GeoPackage is an SQLite file."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TYPES = {"INTEGER": T.LongType(), "INT": T.LongType(), "MEDIUMINT": T.LongType(), "SMALLINT": T.LongType(), "TINYINT": T.LongType(), "BOOLEAN": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType()}
#: Columns that a table import leaves out.
DROPPED = ("fid", "geom", "cat")


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def layers(path: str) -> list[str]:
    with _open(path) as db:
        return [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents ORDER BY table_name")]


class _Part(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, layer: str, schema: T.StructType, parts: int):
        self.path, self.layer, self.schema, self.parts = path, layer, schema, parts
        self.where: list[str] = []

    def partitions(self):
        with _open(self.path) as db:
            low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.layer}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Part(a, min(high, a + step - 1)) for a in range(low, high + 1, step)] or [_Part(0, -1)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        columns = ", ".join(f'"{c}"' for c in self.schema.names)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        with _open(self.path) as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.layer}" WHERE {where}', [partition.low, partition.high])


class GeoPackage(DataSource):
    """Options: path, layer, columns ("table" leaves geometry out, "all" keeps it as bytes), parts, ids (a JSON list) of the column id."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _layer(self) -> str:
        layer = self.options.get("layer")
        if not layer:
            found = layers(self.options["path"])
            if len(found) != 1:
                raise ValueError(f"layer is needed, one of {found}")
            layer = found[0]
        return layer

    def schema(self) -> T.StructType:
        every = self.options.get("columns", "table") == "all"
        with _open(self.options["path"]) as db:
            info = db.execute(f'PRAGMA table_info("{self._layer()}")').fetchall()
        if not info:
            raise ValueError(f"no layer {self._layer()}")
        fields = []
        for _, name, kind, *_ in info:
            base = (kind or "").upper().split("(")[0]
            if base in ("GEOMETRY", "POINT", "LINESTRING", "POLYGON", "MULTILINESTRING", "MULTIPOLYGON", "MULTIPOINT", "BLOB"):
                if every:
                    fields.append(T.StructField(name, T.BinaryType()))
            elif every or name.lower() not in DROPPED:
                fields.append(T.StructField(name, _TYPES.get(base, T.StringType())))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> _Reader:
        reader = _Reader(self.options["path"], self._layer(), schema, int(self.options.get("parts", 8)))
        if "ids" in self.options:
            ids = json.loads(self.options["ids"])
            reader.where.append(f'"{self.options["id"]}" IN ({",".join(map(str, map(int, ids)))})' if ids else "0")
        return reader


def read_geopackage(spark: SparkSession, path: str, import_as: str = "table", layer: str | None = None, ids: Sequence[int] | None = None, name: str = "stream"):
    """A layer as a table, as a ``graph`` (RiverNetwork) or with ``geometry``; ``ids`` are looked up by SQLite.

    Geometry comes as ``parts`` (an array of arrays of struct<x, y>: the points,
    the lines, or all rings of all polygons, outer ones before their holes) and
    as ``geom``, the first of them. The file must be mounted on every executor.
    """
    if import_as not in ("table", "graph", "geometry"):
        raise ValueError("import_as is table, graph or geometry")
    spark.dataSource.register(GeoPackage)
    read = spark.read.format("geopackage").option("columns", "all" if import_as == "geometry" else "table")
    if layer:
        read = read.option("layer", layer)
    if ids is not None:
        read = read.option("id", name).option("ids", json.dumps([int(i) for i in ids]))
    df: DataFrame = read.load(path)
    if import_as == "table":
        return df
    if import_as == "graph":
        from thalweg.operators.network import RiverNetwork

        return RiverNetwork(df)
    xy = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    rest = [f for f in df.schema.fields if f.name != "geom"]

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if b is None else [[{"x": x, "y": y} for x, y in p.tolist()] for p in parse_parts(b)] for b in batch.column("geom").to_pylist()]
            yield pa.record_batch([*(batch.column(f.name) for f in rest), pa.array([f[0] if f else None for f in found], pa.list_(point)), pa.array(found, pa.list_(pa.list_(point)))], names=[*(f.name for f in rest), "geom", "parts"])

    return df.select(*[f.name for f in rest], "geom").mapInArrow(shape, T.StructType([*rest, T.StructField("geom", T.ArrayType(xy)), T.StructField("parts", T.ArrayType(T.ArrayType(xy)))]))


def _shape(raw: bytes, at: int) -> tuple[list[np.ndarray], int]:
    """The coordinate runs of a well-known-binary geometry and the place behind it; further dimensions are left out."""
    order = "<" if raw[at] == 1 else ">"
    (code,) = struct.unpack_from(f"{order}I", raw, at + 1)
    kind, more = code % 1000, code // 1000
    dims, at = 2 + (more in (1, 2)) + 2 * (more == 3), at + 5

    def run(n: int, at: int) -> tuple[np.ndarray, int]:
        return np.frombuffer(raw, f"{order}f8", n * dims, at).reshape(n, dims)[:, :2], at + 8 * n * dims

    if kind == 1:
        one, at = run(1, at)
        return [one], at
    (n,) = struct.unpack_from(f"{order}I", raw, at)
    at += 4
    if kind == 2:
        one, at = run(n, at)
        return [one], at
    out = []
    for _ in range(n):
        if kind == 3:
            (k,) = struct.unpack_from(f"{order}I", raw, at)
            one, at = run(k, at + 4)
            out.append(one)
        elif kind in (4, 5, 6, 7):
            some, at = _shape(raw, at)
            out += some
        else:
            raise ValueError(f"geometry of type {kind} is not read")
    return out, at


def parse_parts(blob: bytes) -> list[np.ndarray]:
    """All points, lines or rings of a GeoPackage geometry, as arrays of (x, y)."""
    raw = bytes(blob)
    return _shape(raw, 8 + (0, 32, 48, 48, 64)[(raw[3] >> 1) & 7])[0]


def parse_geometry(blob: bytes | None) -> list[tuple[float, float]] | None:
    """Points of a GeoPackage geometry's first part: a point, a line, or the outer ring of a polygon."""
    if blob is None:
        return None
    parts = parse_parts(blob)
    return [(x, y) for x, y in parts[0].tolist()] if parts else []


#: Well-known-binary codes.
KINDS = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3}


def geometry_blob(points: Sequence[tuple[float, float]] | None, kind: str, srs: int = 4326) -> bytes | None:
    """A GeoPackage geometry of a point, a line or one ring."""
    if points is None:
        return None
    body = b"".join(struct.pack("<dd", x, y) for x, y in points)
    head = {"POINT": b"", "LINESTRING": struct.pack("<I", len(points)), "POLYGON": struct.pack("<II", 1, len(points))}[kind]
    return b"GP\x00\x01" + struct.pack("<iBI", srs, 1, KINDS[kind]) + head + body


def write_geopackage(df: DataFrame, path: str, layer: str, geom: str | None = None, kind: str = "LINESTRING") -> None:
    """A layer from a table that fits one machine (exchange with desktop tools).

    ``geom`` names a column of array<struct<x, y>> that becomes the geometry, of
    the ``kind`` given, in geographic coordinates.
    """
    kinds = {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "double": "REAL", "float": "REAL"}
    fields = [f for f in df.schema.fields if f.name != geom]
    columns = ", ".join([*([f"geom {kind}"] if geom else []), *(f'"{f.name}" {kinds.get(f.dataType.typeName(), "TEXT")}' for f in fields)])
    names = ", ".join([*(["geom"] if geom else []), *(f'"{f.name}"' for f in fields)])
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT)")
        db.execute("INSERT OR REPLACE INTO gpkg_contents (table_name, data_type) VALUES (?, ?)", (layer, "features" if geom else "attributes"))
        if geom:
            db.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
            db.execute("DELETE FROM gpkg_geometry_columns WHERE table_name = ?", (layer,))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, 4326, 0, 0)", (layer, kind))
        db.execute(f'DROP TABLE IF EXISTS "{layer}"')
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, {columns})')
        marks = ",".join("?" * (len(fields) + bool(geom)))
        rows = df.select(*([geom] if geom else []), *[f.name for f in fields]).toLocalIterator()
        shaped = ((geometry_blob(None if r[0] is None else [(p["x"], p["y"]) for p in r[0]], kind), *r[1:]) if geom else tuple(r) for r in rows)
        db.executemany(f'INSERT INTO "{layer}" ({names}) VALUES ({marks})', shaped)
