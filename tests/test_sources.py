"""Sources, table builders, geometry, catalog and streaming on small inputs."""

import math
import os
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from thalweg.functions import scalars as S
from thalweg.operators import catalog as C
from thalweg.operators import cleaning as L
from thalweg.operators import evaluate as E
from thalweg.operators import geometry as GEO
from thalweg.operators import grid as G
from thalweg.operators import tables as T
from thalweg.operators.network import RiverNetwork
from thalweg.sources import files
from thalweg.sources.geopackage import layers, parse_geometry, read_geopackage, write_geopackage


def blob(kind, *points):
    head = b"GP\x00\x01" + struct.pack("<i", 4326)
    body = struct.pack("<BI", 1, kind)
    if kind == 1:
        return head + body + struct.pack("<dd", *points[0])
    if kind == 3:
        body += struct.pack("<I", 1)
    return head + body + struct.pack("<I", len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


@pytest.fixture(scope="module")
def package(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gpkg") / "net.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT)")
        db.execute("INSERT INTO gpkg_contents VALUES ('streams', 'features')")
        db.execute("CREATE TABLE streams (fid INTEGER PRIMARY KEY, geom LINESTRING, cat INTEGER, length REAL, stream INTEGER, next_stream INTEGER, name TEXT)")
        db.executemany("INSERT INTO streams VALUES (?, ?, ?, ?, ?, ?, ?)", [(k, blob(2, (k, 0.0), (k + 1.0, 1.0)), k, 2.5 * k, k, k - 1 or -1, f"s{k}") for k in range(1, 30)])
    return path


def test_geopackage(spark, package):
    t = read_geopackage(spark, package)
    assert t.columns == ["length", "stream", "next_stream", "name"]
    assert t.count() == 29
    some = read_geopackage(spark, package, ids=[3, 7, 99])
    assert sorted(r["stream"] for r in some.collect()) == [3, 7]
    g = read_geopackage(spark, package, "graph")
    assert isinstance(g, RiverNetwork) and g.links.count() == 28
    shape = read_geopackage(spark, package, "geometry", ids=[2]).first()["geom"]
    assert [(p["x"], p["y"]) for p in shape] == [(2.0, 0.0), (3.0, 1.0)]
    with sqlite3.connect(package) as db:
        db.execute("INSERT OR IGNORE INTO gpkg_contents VALUES ('zz', 'features')")
    assert layers(package) == ["streams", "zz"]
    with pytest.raises(Exception, match="layer is needed"):
        read_geopackage(spark, package)
    assert read_geopackage(spark, package, layer="streams").count() == 29
    assert parse_geometry(blob(1, (1.0, 2.0))) == [(1.0, 2.0)]
    assert parse_geometry(blob(3, (0.0, 0.0), (1.0, 0.0), (0.0, 1.0))) == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    assert parse_geometry(None) is None


def test_geopackage_writer(spark, tmp_path):
    path = str(tmp_path / "out.gpkg")
    write_geopackage(spark.createDataFrame([(1, 0.5, "a"), (2, None, "b")], "id long, v double, t string"), path, "x")
    assert sorted(read_geopackage(spark, path).collect()) == sorted([(1, 0.5, "a"), (2, None, "b")])


def test_geometry_of_many_parts(spark, tmp_path):
    from thalweg.sources.geopackage import geometry_blob, parse_parts

    ring, hole, other = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 0.5), (2.0, 0.5), (2.0, 1.0), (1.0, 0.5)], [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0), (9.0, 9.0)]
    polygon = lambda *rings: struct.pack(">BII", 0, 1003, len(rings)) + b"".join(struct.pack(">I", len(r)) + b"".join(struct.pack(">ddd", x, y, 7.0) for x, y in r) for r in rings)
    many = b"GP\x00\x03" + struct.pack("<i", 4326) + struct.pack("<4d", 0, 10, 0, 10) + struct.pack("<BII", 1, 6, 2) + polygon(ring, hole) + polygon(other)
    assert [list(map(tuple, p.tolist())) for p in parse_parts(many)] == [ring, hole, other]
    assert parse_geometry(many) == ring and parse_geometry(None) is None
    path = str(tmp_path / "out.gpkg")
    lines = spark.createDataFrame([(1, [(0.0, 1.0), (2.0, 3.0)], "a"), (2, None, "b")], "stream long, shape array<struct<x: double, y: double>>, name string")
    write_geopackage(lines, path, "lines", "shape")
    back = {r["stream"]: r for r in read_geopackage(spark, path, "geometry").collect()}
    assert [(p["x"], p["y"]) for p in back[1]["geom"]] == [(0.0, 1.0), (2.0, 3.0)] and back[2]["geom"] is None and len(back[1]["parts"]) == 1
    assert parse_geometry(geometry_blob(ring, "POLYGON")) == ring and parse_geometry(geometry_blob([(5.0, 6.0)], "POINT")) == [(5.0, 6.0)]
    assert [r["name"] for r in read_geopackage(spark, path, ids=[2]).collect()] == ["b"] and read_geopackage(spark, path, ids=[]).count() == 0


def test_files(spark, tmp_path):
    os.makedirs(tmp_path / "a/b")
    (tmp_path / "a/bio1_h01v02.txt").write_text("subcID mean\n1 2.345\n2 3.5\n")
    (tmp_path / "a/b/bio1_h01v03.txt").write_text("subcID mean\n3 4.5\n")
    t = files.read_tiles(spark, str(tmp_path), "bio1", ["h01v02", "h01v03"], "subcID long, mean double")
    assert sorted(tuple(r) for r in t.collect()) == [(1, 2.345, "h01v02"), (2, 3.5, "h01v02"), (3, 4.5, "h01v03")]
    with pytest.raises(FileNotFoundError):
        files.read_tiles(spark, str(tmp_path), "bio1", ["h01v02", "h09v09"], "subcID long, mean double")
    tagged = files.read_tagged(spark, [(str(tmp_path / "a/bio1_h01v02.txt"), "planned", "x"), (str(tmp_path / "a/b"), "built", "y")], "subcID long, mean double", " ")
    assert {(r["status"], r["stage"]) for r in tagged.collect()} == {("planned", "x"), ("built", "y")}
    for kind in ("csv", "json", "orc", "parquet"):
        files.save(tagged, str(tmp_path / f"o.{kind}"), compression="high")
        assert os.listdir(tmp_path / f"o.{kind}")
    points = spark.createDataFrame([("S1", 10.2, 54.3)], "site_id string, lon double, lat double")
    files.save(L.points_geojson(points), str(tmp_path / "p.geojson"))
    assert '"coordinates":[10.2,54.3]' in spark.read.text(str(tmp_path / "p.geojson")).first()[0]
    files.split_files(spark.range(25), ["id"], 10, str(tmp_path / "chunks"))
    assert sorted(d for d in os.listdir(tmp_path / "chunks") if d.startswith("chunk")) == ["chunk=1", "chunk=2", "chunk=3"]


def test_chunks(spark):
    def sizes(compat):
        return [r["n"] for r in T.chunked(spark.range(25), ["id"], 10, compat).groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()]

    assert sizes(False) == [10, 10, 5]
    assert sizes(True) == [9, 10, 6]


def test_statistics_subset(spark):
    t = spark.createDataFrame([(1, 0.0, 1.0, 1.0, 0.5, 0.1)], "subc_id long, min double, max double, range double, mean double, sd double")
    assert T.table_stats(t, "subc_id", ["mean", "sd"]).columns == ["subc_id", "mean", "sd"]
    assert T.table_stats(t.drop("sd"), "subc_id", ["mean"]).columns == ["subc_id", "min", "max", "range", "mean"]
    with pytest.raises(ValueError, match="unknown"):
        T.table_stats(t, "subc_id", ["mode"])
    wide = T.predict_table(t.select("subc_id"), {"bio1": [t], "c10": [t.select("subc_id", F.col("mean").alias("c10_1992"))]}, statistics=["mean"], land_cover=lambda v: v.startswith("c"))
    assert wide.columns == ["subc_id", "bio1_mean", "c10_1992"]


def test_pseudo_absences(spark):
    p = spark.range(1, 101).select(F.col("id").alias("subc_id"), (F.col("id") * 2.0).alias("v"))
    points = spark.createDataFrame([(k,) for k in (1, 2, 2, 0, None)], "subc_id long")
    got = T.modelfit_table(points, p, 10)
    assert got.where("pres_abs = 1").count() == 2 and got.where("pres_abs = 0").count() == 10
    assert got.where("pres_abs = 0 and subc_id in (1, 2)").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.modelfit_table(points, p, 10).collect()))
    assert T.absences(points.where("subc_id > 0"), p.select("subc_id"), 0.1, "subc_id").count() == 18


def test_geometry(spark):
    d = GEO.point_distances(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 0.0)], "id long, lon double, lat double")).collect()
    assert len(d) == 3
    assert all(abs(r["dist"] - 111195) < 20 for r in d if r["from"] == 1)
    line = spark.createDataFrame([(7, 3, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)])], "subc_id long, strahler int, geom array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(1, 0.1, 0.5, 7), (2, 0.5, 1.05, 7), (3, 50.0, 50.0, 7)], "id long, lon double, lat double, subc_id long")
    own = {r["id"]: r for r in GEO.snap_to_own_segment(p, line).collect()}
    assert math.isclose(own[1]["lon_snap"], 0.0, abs_tol=1e-9) and math.isclose(own[1]["lat_snap"], 0.5, abs_tol=1e-9)
    assert math.isclose(own[1]["fraction"], 0.25, abs_tol=0.001)
    near = {r["id"] for r in GEO.nearest_segment(p.drop("subc_id"), line, 20_000.0).collect()}
    assert near == {1, 2}
    assert GEO.clip_line([(-1, 0.5), (2, 0.5)], (0, 0, 1, 1)) == [[(0.0, 0.5), (1.0, 0.5)]]
    assert len(GEO.clip_line([(-1, 0.5), (0.5, 0.5), (0.5, 2), (0.7, 2), (0.7, 0.5)], (0, 0, 1, 1))) == 2
    assert sorted(GEO.clip_polygon([(-1, -1), (2, -1), (2, 2), (-1, 2)], (0, 0, 1, 1))) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    cut = GEO.clip_vectors(line.drop("strahler"), (-0.5, 0.25, 0.5, 2.0)).first()["geom"]
    assert [(q["x"], q["y"]) for q in cut] == [(0.0, 0.25), (0.0, 1.0), (0.5, 1.0)]


def test_network_distance(spark):
    net = RiverNetwork(spark.createDataFrame([(0, -1, 10.0), (1, 0, 10.0), (2, 0, 6.0), (3, 9, 1.0)], "subc_id long, target long, length double"))
    at = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.5), ("c", 0, 0.25), ("d", 1, 0.9), ("e", 3, 0.1)], "id string, subc_id long, fraction double")
    got = {(r["from"], r["to"]): round(r["dist"], 6) for r in GEO.network_distances(net, at).collect()}
    assert got == {("a", "b"): 8.0, ("a", "c"): 7.5, ("a", "d"): 4.0, ("b", "c"): 5.5, ("b", "d"): 4.0, ("c", "d"): 3.5}


def test_grid(spark):
    # flow eastwards along row 0, and from (1, 1) north
    d = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 0), (1, 1, 64)], "cell_row long, cell_col long, value long")
    got = {(r["cell_row"], r["cell_col"]) for r in G.upstream_cells(d, spark.createDataFrame([("o", 0, 1)], "outlet string, cell_row long, cell_col long")).collect()}
    assert got == {(0, 0), (0, 1), (1, 1)}
    with pytest.raises(ValueError, match="type"):
        G.reclass(d, d, type="Float")
    with pytest.raises(ValueError, match="integer"):
        G.reclass(d, spark.createDataFrame([(1.0, 2.0)], "rast_val double, new_val double"))
    lake = spark.createDataFrame([("L", 1, 1)], "lake_id string, cell_row long, cell_col long")
    streams = spark.createDataFrame([(0, 1, 5), (2, 2, 5), (2, 0, 6)], "cell_row long, cell_col long, value long")
    flow = spark.createDataFrame([(0, 1, 10.0), (2, 2, 50.0), (2, 0, 20.0)], "cell_row long, cell_col long, value double")
    out = G.lake_intersections(lake, streams, flow).orderBy("outlet_id").collect()
    assert [(r["subc_id"], r["flow"], r["outlet_id"]) for r in out] == [(5, 50.0, 1), (6, 20.0, 2)]
    near = {r["id"]: r["subc_id"] for r in GEO.snap_to_cells(spark.createDataFrame([(1, 0.5, -0.5), (2, 30.0, -30.0)], "id long, lon double, lat double"), streams, G.Grid(0.0, 0.0, 1.0, 1.0), 3).collect()}
    assert near == {1: 5, 2: None}
    area = G.area_by_value(spark.createDataFrame([(90, 0, 1)], "cell_row long, cell_col long, value long"), G.Grid(-180.0, 90.0, 1.0, 1.0)).first()["km2"]
    assert abs(area - 12363) < 10


def test_catalog(spark):
    rows = [("r.stream.order/order_topo_tiles20d/order_topo_h16v02.tif", "a", 27330052), ("x/order_topo_ovr.tif", "b", 6125520067), ("u/regional_unit_33.tif", "c", 780854), ("x/bio1_1981-2010_observed_h16v02.zip", "d", 161)]
    c = C.with_names(spark.createDataFrame(rows, "file_path string, file_id string, file_size long"))
    assert C.tile_filesize(c, "order_topo", "tif", "h16v02") == 27330052
    assert C.tile_filesize(c, "order_topo", whole=True) == 6125520067
    assert C.tile_filesize(c, "regional_unit", "tif", 33) == 780854
    for bad in (("nothing", "tif", "h16v02"), ("order_topo", "tif", "h99v99"), ("regional_unit", "tif", 130)):
        with pytest.raises(ValueError):
            C.tile_filesize(c, *bad)
    got = C.download_size(c, ["bio1_1981-2010_observed", "gone"], ["h16v02"]).first()
    assert (got["files"], got["missing"], got["bytes"]) == (2, 1, 161)
    with pytest.raises(ValueError, match="unknown tiles"):
        C.download_size(c, ["gone"], ["h77v77"])
    wanted = C.combine(spark, {"base": ["bio1"], "period": ["1981-2010", "2041-2070"], "kind": ["observed"]})
    with pytest.raises(ValueError, match="not available"):
        C.check_available(wanted, c)
    assert C.check_available(wanted, c, True).count() == 1


def test_checks(spark):
    p = spark.createDataFrame([("a", 200.0, 10.0), ("a", 1.0, 95.0)], "id string, lon double, lat double")
    with pytest.raises(ValueError, match="longitude.*latitude.*repeated"):
        L.check_points(p, "lon", "lat", "id")
    with pytest.raises(ValueError, match="no column"):
        L.check_points(p, "x", "lat")


def test_evaluation(spark):
    preds = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.4, 1), (0.3, 0), (0.4, 0), (0.1, 0)], "score double, observed int")
    assert math.isclose(E.auc(preds).first()["auc"], 8 / 9)
    best = E.best_threshold(E.tss_sweep(preds), "tss").first()
    assert math.isclose(best["t"], 0.31) or math.isclose(best["tss"], 2 / 3, rel_tol=1e-9)
    few = E.folds(preds.withColumn("id", F.monotonically_increasing_id()), "id")
    assert sorted(r["fold"] for r in few.where("observed = 1").collect()) == [1, 2, 3]
    model = E.forest(preds, ["score"], trees=5)
    assert model.getNumTrees == 5


def test_scalars(spark):
    one = spark.createDataFrame([(-20.5, 5.28, 0.5, 60.0, None, 3.0)], "a double, b double, c double, d double, e double, f double")
    low, high = S.outward(F.col("a"), F.col("b"))
    got = one.select(low.alias("lo"), high.alias("hi"), S.lake_buffer(F.col("d")).alias("w"), S.truncated(F.lit(-1.23456)).alias("t"), S.row_mean("e", "f").alias("m"), S.row_count("e", "f").alias("n"), S.clamp(F.lit(7)).alias("c"), S.mapped(F.col("c"), {0.5: "x"}).alias("k")).first()
    assert tuple(got) == (-21, 6, 0.0027, -1.234, 3.0, 1, 1.0, "x")


def test_streaming(spark, tmp_path):
    from thalweg.streaming.ingest import counts_by_window, new_occurrences

    src = str(tmp_path / "in")
    spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:10:00', 'a'), (1, timestamp'2024-01-01 00:20:00', 'a'), (2, timestamp'2024-01-01 02:00:00', 'b') AS t(id, ts, kind)").write.parquet(src)
    stream = spark.readStream.schema("id int, ts timestamp, kind string").parquet(src)
    q = new_occurrences(stream, "id", "ts").writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fresh").count() == 2
    q = counts_by_window(stream, "ts", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["kind"], r["n"]) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_scratch_tables(spark):
    from thalweg.plans import scratch

    t = scratch.materialize(spark.range(5), "five")
    assert t.count() == 5 and t.dtypes == spark.range(5).dtypes
    assert scratch.drop_scratch(spark) >= 1
    assert scratch.drop_scratch(spark) == 0


def test_raster_files(spark, tmp_path):
    import zlib

    import numpy as np

    from thalweg.sources import geotiff as R

    rng = np.random.default_rng(2)
    for kind, compression, shape in (("u1", "none", (5, 300)), ("i4", "high", (300, 20)), ("f8", "low", (257, 257)), ("i2", "low", (1, 1))):
        cells = rng.integers(0, 100, shape).astype(kind)
        data = R.image(cells, -10.0, 20.0, 0.5, 0.25, 7.0, compression, 64)
        info = R.describe(data)
        assert (info["width"], info["height"], info["nodata"], info["x0"], info["y0"], info["dx"], info["dy"]) == (shape[1], shape[0], 7.0, -10.0, 20.0, 0.5, 0.25)
        got = np.zeros(shape)
        for _, row, col, block in R.blocks(data, info):
            got[row : row + block.shape[0], col : col + block.shape[1]] = block
        assert (got == cells).all()
    # big-endian strips of two bands with differencing, as other programs write them
    bands = rng.integers(0, 200, (4, 6, 2)).astype(">u2")
    diff = bands.copy()
    diff[:, 1:] -= bands[:, :-1]
    strips = [zlib.compress(diff[k : k + 3].tobytes()) for k in (0, 3)]
    tags = [(256, 4, [6]), (257, 4, [4]), (258, 3, [16, 16]), (259, 3, [8]), (273, 4, [8, 8 + len(strips[0])]), (277, 3, [2]), (278, 4, [3]), (279, 4, [len(s) for s in strips]), (317, 3, [2])]
    at = 8 + sum(map(len, strips))
    after, extra, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, code, values in tags:
        raw = struct.pack(f">{len(values)}{'H' if code == 3 else 'I'}", *values)
        if len(raw) > 4:
            entries += struct.pack(">HHII", tag, code, len(values), after + len(extra))
            extra += raw
        else:
            entries += struct.pack(">HHI", tag, code, len(values)) + raw.ljust(4, b"\0")
    path = tmp_path / "two.tif"
    path.write_bytes(struct.pack(">2sHI", b"MM", 42, at) + b"".join(strips) + struct.pack(">H", len(tags)) + entries + struct.pack(">I", 0) + extra)
    got = {(r["cell_row"], r["cell_col"]): r["value"] for r in R.read_raster(spark, str(path), band=2).collect()}
    assert got == {(r, c): float(bands[r, c, 1]) for r in range(4) for c in range(6)}
    row = R.raster_info(spark, str(path)).first()
    assert (row["bands"], row["type"], row["nodata"], row["compressed"]) == (2, "UInt16", None, True)
    with pytest.raises(ValueError, match="not a TIFF"):
        R.describe(b"nothing at all")


def test_tiles_of_a_raster_share_rows_and_columns(spark, tmp_path):
    from thalweg.sources.geotiff import read_raster, report_no_data, write_raster

    grid = G.Grid(-180.0, 90.0, 0.1, 0.1)
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 1, None), (130, 7, 6.0), (9, 260, -3.0)], "cell_row long, cell_col long, value double")
    files = write_raster(cells, str(tmp_path / "r"), grid, "Int16", -1.0, "high", 128).collect()
    assert sorted(r["cells"] for r in files) == [1, 1, 1]
    back = read_raster(spark, str(tmp_path / "r"), grid, keep_no_data=False)
    assert sorted(map(tuple, back.collect())) == [(0, 0, 5.0), (9, 260, -3.0), (130, 7, 6.0)]
    assert read_raster(spark, str(tmp_path / "r"), grid).where("cell_row = 0 and cell_col = 1").first()["value"] is None
    assert {r["NoData"] for r in report_no_data(spark, str(tmp_path / "r")).collect()} == {-1.0}
    assert write_raster(cells.limit(0), str(tmp_path / "e"), grid).collect() == []


def test_ids_by_mode(spark):
    from thalweg.operators.lookup import get_ids, restore_order

    segments = spark.createDataFrame([(1, -1, 10, 3, 2), (2, 1, 10, 3, 1), (3, 2, 10, 3, 1), (9, -1, 11, 4, 1)], "subc_id long, target long, basin_id long, reg_id long, strahler int")
    cells = spark.createDataFrame([(0, 0, 2.0), (0, 1, 9.0)], "cell_row long, cell_col long, value double")
    points = spark.createDataFrame([("b", 0.5, 89.5, 1), ("a", 1.5, 89.5, 2), ("z", 50.0, 0.0, 3), ("b", 0.5, 89.5, 4)], "site_id string, longitude double, latitude double, subc_id int")
    grid = G.Grid(0.0, 90.0, 1.0, 1.0)
    ids = lambda **k: sorted(r["subc_id"] for r in get_ids(segments, "basin", **k).collect())
    assert ids(basin_ids=[10]) == [1, 2, 3] and ids(subc_ids=[3, 9], min_strahler=1) == [1, 2, 3, 9] and ids(basin_ids=[10], min_strahler=2) == [1]
    assert ids(points=points.where("site_id = 'a'"), cells=cells, grid=grid) == [9] and ids(basin_ids=[77]) == []
    up = get_ids(segments, "upstream", points, cells=cells, grid=grid, comment="c").collect()
    assert sorted((r["site_id"], r["subc_id"], r["upstream_id"], r["comment"]) for r in up) == [("a", 9, 9, "c"), ("b", 2, 2, "c"), ("b", 2, 2, "c"), ("b", 2, 3, "c"), ("b", 2, 3, "c")]
    local = get_ids(segments, "local", points, cells=cells, grid=grid)
    assert local.columns == ["site_id", "longitude", "latitude", "subc_id", "basin_id", "reg_id"]
    assert sorted((r["site_id"], r["basin_id"], r["reg_id"]) for r in local.where("basin_id is not null").collect()) == [("a", 11, 4), ("b", 10, 3), ("b", 10, 3)] and local.count() == 4
    order = spark.createDataFrame([("z", 1), ("b", 2), ("a", 3), ("b", 0)], "site_id string, at int")
    back = restore_order(spark.createDataFrame([("a",), ("z",), ("b",), ("new",)], "site_id string"), order, "site_id", "at")
    assert [r["site_id"] for r in back.orderBy("row_no").collect()] == ["b", "z", "a", "new"]
    for wrong in ({"mode": "other"}, {"basin_ids": [1], "subc_ids": [2]}, {}, {"mode": "upstream"}, {"mode": "local"}, {"points": points}, {"basin_ids": [1], "min_strahler": 0}):
        with pytest.raises(ValueError):
            get_ids(segments, **wrong)
    with pytest.raises(ValueError, match="longitude"):
        get_ids(segments, "local", points.drop("longitude"), cells=cells, grid=grid)


def test_outlines_with_holes_and_corners(spark):
    ring = [(r, c, 1) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    cells = spark.createDataFrame([*ring, (5, 5, 2), (6, 6, 2)], "cell_row int, cell_col int, value int")
    rings = GEO.outline_rings(GEO.cell_outlines(cells, G.Grid(0.0, 0.0, 1.0, 1.0))).collect()

    def area(p):
        return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(p, p[1:] + p[:1])) / 2

    assert sorted((r["zone"], area(r["ring"])) for r in rings) == [(1, -9.0), (1, 1.0), (2, -1.0), (2, -1.0)]


def test_models(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -0.5] + rng.normal(size=60) * 0.3
    df = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double")
    m = E.LinearModel(df, "y", ["a", "b"])
    full = np.column_stack([np.ones(60), x])
    want = np.linalg.lstsq(full, y, rcond=None)[0]
    assert [r["estimate"] for r in m.table(spark).collect()] == pytest.approx(list(want))
    rest = y - full @ want
    assert m.s2 == pytest.approx(rest @ rest / 57)
    r = m.predict(df.where("id = 0")).first()
    half = E.t_quantile(0.975, 57) * math.sqrt(m.s2 * (1 + full[0] @ np.linalg.inv(full.T @ full) @ full[0]))
    assert (r["upper"] - r["lower"]) / 2 == pytest.approx(half) and E.t_quantile(0.975, 57) == pytest.approx(2.002465, abs=1e-5)
    assert E.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and E.t_two_sided(0.0, 5) == pytest.approx(1.0)
    groups = df.withColumn("g", (F.col("id") % 2).cast("int"))
    t = E.welch_test(groups, "g", "y").first()
    assert t["p"] == pytest.approx(E.t_two_sided(t["t"], t["df"]))
    seen = df.withColumn("observed", (F.col("a") > 0).cast("int"))
    fall = {r["variable"]: r["importance"] for r in E.permutation_importance(seen, lambda p: p["a"], ["a", "b"], "observed", "id", 2).collect()}
    assert fall["a"] > 0.2 and fall["b"] == 0.0


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for values in ([1.0], [2.0] * 50 + [3.0], list(rng.normal(size=500)), [0.0] * 400 + list(rng.random(100) * 1e9)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        got = E.quantiles(df, "v", [0, 0.1, 0.5, 0.77, 1], bins=4, few=3).first()["q"]
        assert got == pytest.approx(list(np.quantile(values, [0, 0.1, 0.5, 0.77, 1])))
    assert E.quantiles(df.limit(0), "v", [0.5]).first()["q"] is None
