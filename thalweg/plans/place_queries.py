"""Registered queries over id lookups, raster files, outlines, orders and predictions, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators import evaluate as E
from thalweg.operators import geometry as GEO
from thalweg.operators import grid as G
from thalweg.operators import habitat as H
from thalweg.operators import network as N
from thalweg.operators import tables as T
from thalweg.operators.lookup import get_ids, restore_order
from thalweg.plans.fixtures import sql, table, view
from thalweg.plans.network_queries import CLOSURE, CUT, closed
from thalweg.plans.network_queries import SQL as NETWORK_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, *views)
        return f

    return add


# --- ids of places ---------------------------------------------------------------

_SEGMENTS = "SELECT subc_id, target, subc_id % 7 AS basin_id, subc_id % 3 AS reg_id, CAST(1 + subc_id % 4 AS INT) AS strahler FROM net"
_PLACED = "SELECT p.id AS site_id, v.value AS subc_id FROM pts p JOIN (SELECT cell_row, cell_col, max(value) AS value FROM cells GROUP BY 1, 2) v ON v.cell_row = CAST(floor((90 - lat) / 0.5) AS BIGINT) AND v.cell_col = CAST(floor((lon + 180) / 60) AS BIGINT) WHERE v.value IS NOT NULL"


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_SEGMENTS.replace("FROM net", "FROM {net}"), net=view(spark, sf, "net"))


def _places(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, G.Grid]:
    points = view(spark, sf, "pts").select(F.col("id").alias("site_id"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    return points, view(spark, sf, "cells"), G.Grid(dx=60.0, dy=0.5)


@query(f"WITH s AS ({_SEGMENTS}) SELECT subc_id FROM s WHERE strahler >= 3 AND basin_id IN (SELECT basin_id FROM s WHERE subc_id IN (3, 12, 19))", "net")
def x1_basin_ids_of_subcatchments(spark: SparkSession, sf: str) -> DataFrame:
    return get_ids(_segments(spark, sf), "basin", subc_ids=[3, 12, 19], min_strahler=3)


@query(f"WITH s AS ({_SEGMENTS}), p AS ({_PLACED}) SELECT subc_id FROM s WHERE basin_id IN (SELECT basin_id FROM s WHERE subc_id IN (SELECT subc_id FROM p))", "net", "cells", "pts")
def x1_basin_ids_of_points(spark: SparkSession, sf: str) -> DataFrame:
    points, cells, grid = _places(spark, sf)
    return get_ids(_segments(spark, sf), "basin", points, cells=cells, grid=grid)


@query(closed(f"SELECT site_id, CAST(p.subc_id AS BIGINT) AS subc_id, c.stream AS upstream_id, 'run' AS comment FROM ({_PLACED}) p JOIN c ON c.base = p.subc_id WHERE 1 + c.stream % 4 >= 2"), "net", "cells", "pts")
def x1_upstream_ids(spark: SparkSession, sf: str) -> DataFrame:
    points, cells, grid = _places(spark, sf)
    return get_ids(_segments(spark, sf), "upstream", points, min_strahler=2, cells=cells, grid=grid, comment="run")


@query(f"WITH s AS ({_SEGMENTS}), p AS ({_PLACED}) SELECT id AS site_id, lon AS longitude, lat AS latitude, p.subc_id, s.basin_id, s.reg_id FROM pts LEFT JOIN p ON p.site_id = id LEFT JOIN s ON s.subc_id = p.subc_id", "net", "cells", "pts")
def x1_local_ids(spark: SparkSession, sf: str) -> DataFrame:
    points, cells, grid = _places(spark, sf)
    return get_ids(_segments(spark, sf), "local", points, cells=cells, grid=grid)


# --- orders ------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY place NULLS LAST, o_custkey, o_orderkey) AS row_no FROM (SELECT o_orderkey, o_custkey, (SELECT min(c_acctbal) FROM customer WHERE c_custkey = o_custkey) AS place FROM orders)")
def w12_restore_order(spark: SparkSession, sf: str) -> DataFrame:
    # the customers' own order is that of their balance
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return restore_order(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), customers, "o_custkey", "c_acctbal").select("o_orderkey", "o_custkey", "row_no")


@query("SELECT subc_id, row_number() OVER (ORDER BY CAST(subc_id AS VARCHAR) DESC) AS row_no FROM net", "net")
def w10_rank_order(spark: SparkSession, sf: str) -> DataFrame:
    n = view(spark, sf, "net").select("subc_id", F.col("subc_id").cast("string").alias("name"))
    return T.row_numbers(n, [F.desc("name")]).select("subc_id", "row_no")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_totalprice DESC, o_orderkey) AS row_no FROM orders")
def o1_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    return T.row_numbers(table(spark, sf, "orders"), ["o_custkey", F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "row_no")


@query("SELECT p_partkey, row_number() OVER (ORDER BY CAST(txt AS DOUBLE), p_partkey) AS row_no FROM (SELECT p_partkey, CAST(p_retailprice AS VARCHAR) AS txt FROM part)")
def o5_typed_sort(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("string").alias("txt"))
    return T.row_numbers(p.withColumn("number", F.col("txt").try_cast("double")), ["number", "p_partkey"]).select("p_partkey", "row_no")


# --- raster files and outlines --------------------------------------------------------

_SIZE = 1024


def _written(spark: SparkSession, sf: str) -> DataFrame:
    """The raster as images, rows of a dataset in the shared folder."""
    from thalweg.plans.scratch import scratch_path
    from thalweg.sources.geotiff import write_images

    return write_images(view(spark, sf, "cells"), scratch_path(spark, "raster"), G.Grid(dx=0.5, dy=0.01), type="Float64", nodata=-9999.0, size=_SIZE)


@query("SELECT cell_row, cell_col, CAST(value AS DOUBLE) AS value FROM cells WHERE value IS NOT NULL", "cells")
def s6_raster_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    from thalweg.sources.geotiff import read_raster

    return read_raster(spark, _written(spark, sf), G.Grid(dx=0.5, dy=0.01), keep_no_data=False)


@query(f"SELECT 'raster_r' || lpad(CAST(cell_row // {_SIZE} AS VARCHAR), 4, '0') || 'c' || lpad(CAST(cell_col // {_SIZE} AS VARCHAR), 4, '0') || '.tif' AS \"Raster\", -9999.0 AS \"NoData\" FROM cells WHERE value IS NOT NULL GROUP BY cell_row // {_SIZE}, cell_col // {_SIZE}", "cells")
def k8_file_no_data(spark: SparkSession, sf: str) -> DataFrame:
    from thalweg.sources.geotiff import report_no_data

    return report_no_data(spark, _written(spark, sf))


_TRIANGLE = ((-179.61, 89.93), (-176.07, 60.02), (-179.83, 40.31))
_CENTRE = "SELECT *, -180 + (cell_col + 0.5) * 0.5 AS x, 90 - (cell_row + 0.5) * 0.01 AS y FROM cells"


def _left_of(a: tuple[float, float], b: tuple[float, float]) -> str:
    return f"({b[0]} - ({a[0]})) * (y - ({a[1]})) - ({b[1]} - ({a[1]})) * (x - ({a[0]})) < 0"


@query(f"SELECT cell_row, cell_col, value FROM ({_CENTRE}) WHERE {' AND '.join(_left_of(_TRIANGLE[k], _TRIANGLE[(k + 1) % 3]) for k in range(3))}", "cells")
def k5_crop_by_polygon(spark: SparkSession, sf: str) -> DataFrame:
    polygon = spark.createDataFrame([(1, list(_TRIANGLE))], "poly_id long, ring array<struct<x: double, y: double>>")
    return GEO.cells_in_polygons(view(spark, sf, "cells"), G.Grid(dx=0.5, dy=0.01), polygon).select("cell_row", "cell_col", "value")


@query("WITH z AS (SELECT DISTINCT cell_row, cell_col, zone FROM cells) SELECT a.zone, 4 * count(*) - 2 * (SELECT count(*) FROM z p JOIN z q ON p.zone = q.zone AND ((q.cell_row = p.cell_row AND q.cell_col = p.cell_col + 1)) WHERE p.zone = a.zone) - 2 * (SELECT count(*) FROM z p JOIN z q ON p.zone = q.zone AND ((q.cell_col = p.cell_col AND q.cell_row = p.cell_row + 1)) WHERE p.zone = a.zone) AS sides FROM z a GROUP BY a.zone", "cells")
def x6_basin_outlines(spark: SparkSession, sf: str) -> DataFrame:
    return GEO.cell_outlines(view(spark, sf, "cells"), G.Grid(0.0, 0.0, 1.0, 1.0), "zone").groupBy("zone").agg(F.count("*").alias("sides"))


@query("SELECT zone, CAST(count(*) AS DOUBLE) AS area FROM cells GROUP BY zone", "cells")
def x6_basin_polygons(spark: SparkSession, sf: str) -> DataFrame:
    # holes run the other way round, so the signed areas of a basin's rings sum to its cells
    rings = GEO.outline_rings(GEO.cell_outlines(view(spark, sf, "cells"), G.Grid(0.0, 0.0, 1.0, 1.0), "zone"))
    turned = F.expr("concat(slice(ring, 2, size(ring) - 1), slice(ring, 1, 1))")
    area = F.aggregate(F.arrays_zip(F.col("ring").alias("a"), turned.alias("b")), F.lit(0.0), lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]) / 2)
    return rings.select("zone", area.alias("s")).groupBy("zone").agg(F.abs(F.sum("s")).alias("area"))


@query("SELECT s_suppkey, round(greatest(x0, 5.03 - w), 6) AS xa, round(least(x0 + 4, 5.03 + w), 6) AS xb FROM (SELECT s_suppkey, CAST(s_suppkey % 10 AS DOUBLE) AS x0, 3.07 - abs(CAST(s_suppkey % 7 AS DOUBLE) - 3.01) AS w FROM supplier) WHERE w > 0 AND greatest(x0, 5.03 - w) < least(x0 + 4, 5.03 + w)")
def k6_clip_by_polygon(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS subc_id", "CAST(s_suppkey % 10 AS DOUBLE) AS x", "CAST(s_suppkey % 7 AS DOUBLE) AS y")
    lines = s.select("subc_id", F.array(F.struct("x", "y"), F.struct((F.col("x") + 4).alias("x"), "y")).alias("geom"))
    diamond = spark.createDataFrame([(1, [(5.03 - 3.07, 3.01), (5.03, 3.01 + 3.07), (5.03 + 3.07, 3.01), (5.03, 3.01 - 3.07)])], "poly_id long, ring array<struct<x: double, y: double>>")
    cut = GEO.lines_in_polygons(lines, diamond)
    return cut.select(F.col("id").alias("s_suppkey"), F.round("x1", 6).alias("xa"), F.round("x2", 6).alias("xb"))


# --- networks -----------------------------------------------------------------------------

_ALL = "p AS (SELECT a.stream AS i, b.stream AS j, min(a.dist + b.dist) AS d FROM c a JOIN c b ON a.base = b.base AND a.stream <> b.stream GROUP BY 1, 2)"


@query(closed("SELECT n.subc_id, coalesce(k, 0) + CASE WHEN n.target >= 0 THEN 1 ELSE 0 END AS degree, round(f, 2) AS farness, round(e, 2) AS eccentricity FROM net_deep n LEFT JOIN (SELECT target, count(*) AS k FROM net_deep GROUP BY 1) t ON t.target = n.subc_id LEFT JOIN (SELECT i, sum(d) AS f, max(d) AS e FROM p GROUP BY 1) q ON q.i = n.subc_id", "net_deep", _ALL), "net_deep")
def g5_centrality_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    t = N.centrality(N.RiverNetwork(view(spark, sf, "net_deep")), "all")
    return t.select("subc_id", "degree", F.round("farness", 2).alias("farness"), F.round("eccentricity", 2).alias("eccentricity"))


_REACH = """o AS (SELECT subc_id, count(*)::DOUBLE AS w FROM occ WHERE species = '2-HIGH' GROUP BY 1),
own AS (SELECT stream, base, hops, dist + n.length AS len, n.length AS own FROM c JOIN net n ON n.subc_id = c.base),
m AS (SELECT a.stream AS i, b.stream AS j, min_by(a.len + b.len - a.own, a.hops + b.hops) AS d FROM own a JOIN own b ON a.base = b.base AND a.stream <> b.stream WHERE a.stream IN (SELECT subc_id FROM o) AND b.stream IN (SELECT subc_id FROM o) GROUP BY 1, 2),
r AS (SELECT i, sum(pow(0.5, d / 5000) * y.w) AS s FROM m JOIN o y ON y.subc_id = j GROUP BY 1)"""


@query(closed("SELECT n.subc_id, round(CASE WHEN o.w IS NULL THEN 0 ELSE o.w + coalesce(r.s, 0) END, 5) AS num FROM net n LEFT JOIN o USING (subc_id) LEFT JOIN r ON r.i = n.subc_id", extra=_REACH), "net", "occ")
def g19_reach_index(spark: SparkSession, sf: str) -> DataFrame:
    w = view(spark, sf, "occ").where("species = '2-HIGH'").groupBy(F.col("subc_id").alias("id")).agg(F.count("*").cast("double").alias("weight"))
    return H.reach_connectivity(N.RiverNetwork(view(spark, sf, "net")), w, 0.5, 1 / 5000).select(F.col("id").alias("subc_id"), F.round("num", 5).alias("num"))


@query(
    "WITH u AS (SELECT n.subc_id AS id, n.length / 1000 AS length_km, 1000 + n.length / 3 AS impact, coalesce((SELECT sum(power_mw) FROM dams d WHERE d.subc_id = n.subc_id AND status = 'planned'), 0) AS mw_sum FROM net n), e AS (SELECT min(impact) AS lo, max(impact) AS hi, max(mw_sum) AS mw FROM u), k AS (SELECT u.*, CASE WHEN impact = lo THEN 1e-6 ELSE (impact - lo) / (hi - lo) END AS cost, mw_sum / mw AS power FROM u, e) SELECT id, round(length_km, 6) AS length_km, round(impact, 6) AS impact, round(mw_sum, 2) AS mw_sum, round(cost, 8) AS cost_impact, round(cost + power, 8) AS cost_impact_power FROM k",
    "net",
    "dams",
)
def b6_planning_units(spark: SparkSession, sf: str) -> DataFrame:
    net = N.RiverNetwork(view(spark, sf, "net"))
    dams = view(spark, sf, "dams").select(F.col("subc_id").alias("id"), "status", F.col("power_mw").alias("power"))
    t = H.planning_units(net, net.edges.select("id", (1000 + F.col("weight") / 3).alias("impact")), dams)
    return t.select("id", F.round("length_km", 6).alias("length_km"), F.round("impact", 6).alias("impact"), F.round("mw_sum", 2).alias("mw_sum"), F.round("cost_impact", 8).alias("cost_impact"), F.round("cost_impact_power", 8).alias("cost_impact_power"))


@query(f"WITH RECURSIVE {CUT}, {CLOSURE.format('cut')}, f AS (SELECT stream AS subc_id, max_by(base, hops) AS fragment FROM c GROUP BY stream) SELECT fragment, strahler, count(*) AS n FROM f JOIN ({NETWORK_SQL['g_strahler']}) o USING (subc_id) GROUP BY fragment, strahler", "net")
def g12_order_distribution(spark: SparkSession, sf: str) -> DataFrame:
    net = N.RiverNetwork(view(spark, sf, "net"))
    return H.order_distribution(N.fragments(net, F.col("barrier")), N.strahler_orders(net))


@query("SELECT o_orderkey, o_custkey, c_acctbal, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def j2_left_join_in_order(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    right = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return restore_order(left.join(right, "o_custkey", "left"), left, "o_orderkey", "o_orderkey").select("o_orderkey", "o_custkey", "c_acctbal", "row_no")


# --- models ---------------------------------------------------------------------------------


@query("SELECT subc_id, round(price_min * 2 + n_orders, 4) AS score FROM attrs", "attrs")
def m11_chunked_prediction(spark: SparkSession, sf: str) -> DataFrame:
    t = E.predict_chunks(view(spark, sf, "attrs").select("subc_id", "price_min", "n_orders"), lambda x: x["price_min"] * 2 + x["n_orders"], ["price_min", "n_orders"], rows=500)
    return t.select("subc_id", F.round("score", 4).alias("score"))


_NETWORK_WAYS = """p AS (SELECT site_id AS p, subc_id AS id, (site_id % 5) / 5.0 AS f FROM dams JOIN net USING (subc_id)),
w AS (SELECT p.p, c.base AS stream, c.hops, CASE WHEN hops = 0 THEN (1 - f) * n.length ELSE c.dist - n.length + (1 - f) * n.length + b.length END AS low, b.length AS len FROM p JOIN c ON c.stream = p.id JOIN net n ON n.subc_id = p.id JOIN net b ON b.subc_id = c.base)"""


@query(closed('SELECT a.p AS "from", b.p AS "to", round(min_by(CASE WHEN a.hops = 0 OR b.hops = 0 THEN abs(a.low - b.low) ELSE a.low + b.low - 2 * a.len END, a.hops + b.hops), 2) AS dist FROM w a JOIN w b ON a.stream = b.stream AND a.p < b.p GROUP BY 1, 2', extra=_NETWORK_WAYS), "net", "dams")
def k13_network_distance(spark: SparkSession, sf: str) -> DataFrame:
    net = N.RiverNetwork(view(spark, sf, "net"))
    at = view(spark, sf, "dams").select(F.col("site_id").alias("id"), "subc_id", ((F.col("site_id") % 5) / 5.0).alias("fraction"))
    return GEO.network_distances(net, at).withColumn("dist", F.round("dist", 2))


@query(closed("SELECT base AS zone, CAST(count(*) AS DOUBLE) AS area FROM c JOIN net ON subc_id = stream WHERE base IN (3, 20, 45) GROUP BY base"), "net")
def x5_catchment_polygons(spark: SparkSession, sf: str) -> DataFrame:
    # one cell for each sub-catchment, 40 in a row
    from thalweg.operators.lookup import catchment_polygons

    net = view(spark, sf, "net")
    cells = net.select(F.expr("subc_id div 40").alias("cell_row"), (F.col("subc_id") % 40).alias("cell_col"), F.col("subc_id").alias("value"))
    rings = catchment_polygons(net, cells, G.Grid(0.0, 0.0, 1.0, 1.0), spark.createDataFrame([(3,), (20,), (45,)], "id long"))
    turned = F.expr("concat(slice(ring, 2, size(ring) - 1), slice(ring, 1, 1))")
    area = F.aggregate(F.arrays_zip(F.col("ring").alias("a"), turned.alias("b")), F.lit(0.0), lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]) / 2)
    return rings.select("zone", area.alias("s")).groupBy("zone").agg(F.abs(F.sum("s")).alias("area"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY length DESC, col) AS nth FROM (SELECT subc_id // 40 AS lake_id, subc_id % 40 AS col, length FROM net WHERE subc_id % 40 IN (0, 7, 20) AND (subc_id // 40) % 5 = 2)) SELECT lake_id, count(*) AS n FROM (SELECT lake_id, min(col) AS col FROM k WHERE nth <= 2 GROUP BY 1) JOIN net ON subc_id // 40 = lake_id AND subc_id % 40 >= col GROUP BY 1", "net")
def k17_lake_catchment(spark: SparkSession, sf: str) -> DataFrame:
    # 40 cells a row, flowing west to its first cell
    n = view(spark, sf, "net").select(F.expr("subc_id div 40").alias("cell_row"), (F.col("subc_id") % 40).alias("cell_col"), "length")
    flow = n.select("cell_row", "cell_col", F.when(F.col("cell_col") == 0, 0).otherwise(16).alias("value"))
    met = n.where("cell_col in (0, 7, 20) and cell_row % 5 = 2").withColumn("lake_id", F.col("cell_row"))
    return G.lake_catchments(met, flow, "length", n=2).groupBy("lake_id").agg(F.count("*").alias("n"))


@query(f"SELECT 1 AS poly_id, cell_row, cell_col FROM ({_CENTRE}) WHERE {' AND '.join(_left_of(_TRIANGLE[k], _TRIANGLE[(k + 1) % 3]) for k in range(3))}", "cells")
def k16_rasterised_lake(spark: SparkSession, sf: str) -> DataFrame:
    polygon = spark.createDataFrame([(1, list(_TRIANGLE))], "poly_id int, ring array<struct<x: double, y: double>>")
    return GEO.rasterise(polygon, view(spark, sf, "cells"), G.Grid(dx=0.5, dy=0.01))


# --- draws: what must hold of them whatever the hash order ------------------------------------


@query("SELECT 1 AS pres_abs, count(*) AS n, count(*) AS at_presences FROM attrs WHERE subc_id IN (SELECT subc_id FROM occ WHERE species = '2-HIGH' AND subc_id % 9 = 0 AND subc_id <> 0) UNION ALL SELECT 0, least(50, count(*)), 0 FROM attrs WHERE subc_id NOT IN (SELECT subc_id FROM occ WHERE species = '2-HIGH' AND subc_id % 9 = 0 AND subc_id <> 0)", "attrs", "occ")
def b3_pseudo_absence_counts(spark: SparkSession, sf: str) -> DataFrame:
    points = view(spark, sf, "occ").where("species = '2-HIGH' and subc_id % 9 = 0")
    drawn = T.modelfit_table(points, view(spark, sf, "attrs").select("subc_id", "price_mean"), 50)
    at = points.where("subc_id <> 0").select("subc_id").distinct().withColumn("there", F.lit(1))
    return drawn.join(at, "subc_id", "left").groupBy("pres_abs").agg(F.countDistinct("subc_id").alias("n"), F.count("there").alias("at_presences"))


@query("SELECT 1000 AS n, 1000 AS distinct_rows, 0 AS strangers FROM (SELECT count(*) AS c FROM orders) WHERE c >= 1000 UNION ALL SELECT c, c, 0 FROM (SELECT count(*) AS c FROM orders) WHERE c < 1000")
def o8_sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey")
    drawn = T.sample_rows(o, 1000, ["o_orderkey"])
    again = T.sample_rows(o.repartition(7), 1000, ["o_orderkey"]).withColumn("again", F.lit(1))
    return drawn.join(again, "o_orderkey", "left").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("distinct_rows"), F.count_if(F.col("again").isNull()).alias("strangers"))


@query("SELECT observed, count(*) AS n, true AS near_a_fifth FROM preds GROUP BY observed", "preds")
def m5_fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    f = E.folds(view(spark, sf, "preds"), "doc_id")
    return f.groupBy("observed").agg(F.count("*").alias("n"), F.avg("fold").between(0.1, 0.3).alias("near_a_fifth"))
