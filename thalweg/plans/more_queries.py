"""Further registered queries: filters, joins, aggregates, windows, sets, lakes, snapping, habitat pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import scalars as S
from thalweg.operators import catalog as C
from thalweg.operators import cleaning as L
from thalweg.operators import evaluate as E
from thalweg.operators import geometry as GEO
from thalweg.operators import grid as G
from thalweg.operators import habitat as H
from thalweg.operators import network as N
from thalweg.operators import tables as T
from thalweg.operators.pfafstetter import pfafstetter
from thalweg.plans.fixtures import sql, table, view
from thalweg.plans.network_queries import CLOSURE, closed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, *views)
        return f

    return add


def plain(name: str, spark_text: str, duck_text: str | None = None, *views: str) -> None:
    """A query that is one SQL text: Spark plans it declaratively; DuckDB's text may differ in its dialect."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        from thalweg.plans.fixtures import TABLES

        names = [t for t in (*TABLES, *views) if f"{{{t}}}" in spark_text]
        return spark.sql(spark_text, **{t: view(spark, sf, t) if t in views else table(spark, sf, t) for t in names})

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = sql((duck_text or spark_text).replace("{", "").replace("}", ""), *views)


# --- filters ---------------------------------------------------------------------

plain("p3_select_columns", "SELECT c_custkey, c_name FROM {customer}")
plain("p6_rename", "SELECT p_partkey AS subc_id, p_size AS strahler FROM {part}")
plain("p7_drop_null_coordinates", "SELECT cell_row, cell_col, value FROM {cells} WHERE value IS NOT NULL AND zone IS NOT NULL", None, "cells")
plain("p10_bounding_box", "SELECT id, lon, lat FROM {pts} WHERE lon BETWEEN -120 AND -90 AND lat BETWEEN -40 AND 10", None, "pts")
plain("p13_coalesce", "SELECT cell_row, cell_col, coalesce(value, -1.0) AS value, nullif(zone, 3) AS zone FROM {cells}", None, "cells")


@query("SELECT subc_id, price_mean, price_min, price_max FROM attrs", "attrs")
def p4_select_like(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "attrs")
    return a.select("subc_id", *T.select_like(a, starts="price_").columns)


@query("SELECT subc_id, lo AS min, hi AS max FROM (SELECT subc_id, price_min AS lo, price_max AS hi FROM attrs)", "attrs")
def p5_statistics_of_six_columns(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "attrs").select("subc_id", F.col("price_min").alias("min"), F.col("price_max").alias("max"), (F.col("price_max") - F.col("price_min")).alias("range"), F.col("price_mean").alias("mean"), F.lit(0.0).alias("sd"))
    return T.table_stats(a, "subc_id", ["min", "max"])


@query("SELECT subc_id, price_mean FROM attrs WHERE price_mean IS NOT NULL AND n_orders IS NOT NULL AND n_orders > 5", "attrs")
def p8_complete_cases(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "attrs").withColumn("n", F.when(F.col("n_orders") > 5, F.col("n_orders")))
    return a.dropna(subset=["price_mean", "n"]).select("subc_id", "price_mean")


@query("SELECT count(*) FILTER (lon < -180 OR lon > 180) AS bad_lon, count(*) FILTER (lat < -90 OR lat > 90) AS bad_lat, count(id) - count(DISTINCT id) AS repeated FROM pts", "pts")
def p16_point_checks(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "pts")
    L.check_points(p, "lon", "lat", "id")
    return p.agg(F.count_if(~F.col("lon").between(-180, 180)).alias("bad_lon"), F.count_if(~F.col("lat").between(-90, 90)).alias("bad_lat"), (F.count("id") - F.count_distinct("id")).alias("repeated"))


# --- joins -------------------------------------------------------------------------


@query(closed("SELECT base, stream, a.n_orders FROM c JOIN attrs a ON a.subc_id = stream", "net"), "net", "attrs")
def j1_closure_attributes(spark: SparkSession, sf: str) -> DataFrame:
    net = N.RiverNetwork(view(spark, sf, "net"))
    pairs = N.closure(net)
    return pairs.join(view(spark, sf, "attrs").select(F.col("subc_id").alias("stream"), "n_orders"), "stream").select("base", "stream", "n_orders")


plain("j4_both_ends", "SELECT n.subc_id, n.target, a.n_orders AS n_from, b.n_orders AS n_to FROM {net} n JOIN {attrs} a ON a.subc_id = n.subc_id JOIN {attrs} b ON b.subc_id = n.target", None, "net", "attrs")
plain("j7_semi_join", "SELECT s_suppkey, s_name FROM {supplier} LEFT SEMI JOIN {nation} ON s_nationkey = n_nationkey AND n_regionkey = 2", "SELECT s_suppkey, s_name FROM supplier SEMI JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 2")
plain("j9_exact_coordinates", "SELECT a.id, b.id AS other FROM {pts} a LEFT JOIN (SELECT lon, lat, min(id) AS id FROM {pts} WHERE id % 2 = 1 GROUP BY lon, lat) b ON a.lon = b.lon AND a.lat = b.lat", None, "pts")
plain("j11_other_key_names", "SELECT d.site_id, d.subc_id, n.length FROM {dams} d LEFT JOIN {net} n ON d.subc_id = n.subc_id", None, "dams", "net")
plain("j13_inner", "SELECT o.species, count(*) AS n FROM {occ} o JOIN {net} n ON o.subc_id = n.subc_id WHERE n.barrier GROUP BY o.species", None, "occ", "net")
plain("j14_three_keys", "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM {lineitem}) a JOIN (SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber, l_partkey) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey")
plain("j15_attach_with_zero", "SELECT n.subc_id, coalesce(k, 0) AS n_points FROM {net} n LEFT JOIN (SELECT subc_id, count(*) AS k FROM {occ} WHERE species = '3-MEDIUM' GROUP BY subc_id) o ON o.subc_id = n.subc_id", None, "net", "occ")


@query("SELECT a.cell_row, a.cell_col, a.zone, b.value FROM cells a JOIN cells b ON a.cell_row = b.cell_row AND a.cell_col = b.cell_col WHERE b.value IS NOT NULL AND a.zone % 2 = 0", "cells")
def j17_overlay(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "cells")
    return G.overlay(c.where("zone % 2 = 0").select("cell_row", "cell_col", "zone"), c.where("value is not null")).select("cell_row", "cell_col", "zone", "value")


plain("j22_symmetric", "SELECT DISTINCT id1, id2 FROM (SELECT subc_id AS id1, target AS id2 FROM {net} WHERE target >= 0 UNION ALL SELECT target, subc_id FROM {net} WHERE target >= 0)", None, "net")


@query("SELECT b || '_' || y AS var FROM (VALUES ('c10'), ('c20')) a(b), (VALUES ('1992'), ('2000'), ('2020')) c(y)")
def j21_combine_names(spark: SparkSession, sf: str) -> DataFrame:
    return C.combine(spark, {"base": ["c10", "c20"], "year": ["1992", "2000", "2020"]}).select("var")


# --- aggregates ----------------------------------------------------------------------

plain("a5_largest_path", "SELECT max_by(o_custkey, s) AS o_custkey, max(s) AS s FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM {orders} GROUP BY o_custkey)")
plain("a7_counts", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, count_if(l_discount = 0) AS zero FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_discount = 0) AS zero FROM lineitem GROUP BY l_returnflag")
plain("a9_global_summary", "SELECT count(*) AS n, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi, round(avg(o_totalprice), 4) AS mean FROM {orders}")
plain("a22_distinct_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM {lineitem}")
plain("a23_coverage", "SELECT 'value' AS name, count(value) AS with_data, count(*) AS n, round(count(value) * 100.0D / count(*), 4) AS pct FROM {cells}", "SELECT 'value' AS name, count(value) AS with_data, count(*) AS n, round(count(value) * 100.0 / count(*), 4)::DOUBLE AS pct FROM cells", "cells")


@query("SELECT subc_id, round((price_min + price_max) / 2, 6) AS m, CASE WHEN n_orders > 8 THEN 3 ELSE 2 END AS n FROM attrs", "attrs")
def a16_row_statistics(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "attrs").withColumn("x", F.when(F.col("n_orders") > 8, 1.0))
    return a.select("subc_id", F.round(S.row_mean("price_min", "price_max"), 6).alias("m"), S.row_count("price_min", "price_max", "x").alias("n"))


@query("SELECT boundary_length FROM (SELECT round(sum(1.0), 4)::DOUBLE AS boundary_length FROM (SELECT subc_id AS a, target AS b FROM net WHERE target >= 0 UNION ALL SELECT target, subc_id FROM net WHERE target >= 0) WHERE a % 3 = 0 AND b % 3 <> 0)", "net")
def b10_boundary_length(spark: SparkSession, sf: str) -> DataFrame:
    net = N.RiverNetwork(view(spark, sf, "net").select("subc_id", "target", "length"))
    return T.boundary_length(H.boundary_matrix(net, 1), net.edges.where("id % 3 = 0").select("id")).select(F.round("boundary_length", 4).alias("boundary_length"))


# --- windows, order, sets, shape --------------------------------------------------------

plain("w2_outlet_numbers", "SELECT s_nationkey AS lake_id, s_suppkey AS subc_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS outlet_id FROM {supplier}")
plain("w4_rank_in_group", "SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS nth FROM {part}")
plain("w7_first_of_group", "SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS k FROM {lineitem}) WHERE k = 1")
plain("w9_running_sum", "SELECT user_id, event_id FROM (SELECT user_id, event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {events}) WHERE before < 200")
plain("o3_top_tributaries", "SELECT o_custkey, s FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM {orders} GROUP BY o_custkey) ORDER BY s DESC, o_custkey LIMIT 4")
plain("o6_head", "SELECT p_partkey, p_name FROM {part} ORDER BY p_partkey LIMIT 10")
plain("u1_union_all", "SELECT s_suppkey AS k FROM {supplier} UNION ALL SELECT c_custkey FROM {customer}")


@query("SELECT DISTINCT subc_id FROM (SELECT subc_id FROM net WHERE length > 8000 UNION ALL SELECT subc_id FROM dams)", "net", "dams")
def u6_union_then_first(spark: SparkSession, sf: str) -> DataFrame:
    both = view(spark, sf, "net").where("length > 8000").select("subc_id").unionAll(view(spark, sf, "dams").select("subc_id"))
    return T.keep_first(both, ["subc_id"], ["subc_id"])


@query("SELECT subc_id, min(tile) AS tile FROM (SELECT subc_id, tile FROM attrs UNION ALL SELECT subc_id, tile + 1 FROM attrs WHERE tile = 0) GROUP BY 1", "attrs")
def u7_concat_tiles(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "attrs").select("subc_id", "tile")
    return T.keep_first(a.unionByName(a.where("tile = 0").withColumn("tile", F.col("tile") + 1)), ["subc_id"], ["tile"])


plain("r3_upper_triangle", "SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query("SELECT subc_id, name[:5] AS variable, name[7:] AS stat, value FROM (SELECT subc_id, price_mean, price_min FROM attrs) UNPIVOT (value FOR name IN (price_mean, price_min))", "attrs")
def r4_separate_names(spark: SparkSession, sf: str) -> DataFrame:
    long = view(spark, sf, "attrs").unpivot(["subc_id"], ["price_mean", "price_min"], "name", "value")
    return long.select("subc_id", F.split_part("name", F.lit("_"), F.lit(1)).alias("variable"), F.split_part("name", F.lit("_"), F.lit(2)).alias("stat"), "value")


@query("SELECT c_custkey, round(c_acctbal * 0.000009, 9) AS deg, trunc(c_acctbal * 1.2345 * 1000) / 1000 AS cut, CASE WHEN c_acctbal <= 1 THEN 0.0009 WHEN c_acctbal <= 50 THEN 0.0018 WHEN c_acctbal <= 100 THEN 0.0027 ELSE 0.0036 END AS buf, greatest(0.0, least(1.0, c_acctbal / 5000)) AS cl, round(1 / (1 + exp(-c_acctbal / 10000)), 9) AS lg FROM customer")
def f_scalars(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.round(S.to_degrees(x), 9).alias("deg"), S.truncated(x * 1.2345).alias("cut"), S.lake_buffer(x).alias("buf"), S.clamp(x / 5000).alias("cl"), F.round(S.logistic(x / 10000), 9).alias("lg"))


# --- rasters, lakes, snapping --------------------------------------------------------------


@query("SELECT subc_id, length FROM net WHERE subc_id IN (SELECT subc_id FROM dams)", "net", "dams")
def k3_segment_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "net").join(view(spark, sf, "dams").select("subc_id"), "subc_id", "left_semi").select("subc_id", "length")


@query("SELECT 'flow' AS Raster, -9999.0::DOUBLE AS NoData UNION ALL SELECT 'subc', NULL")
def k8_report_no_data(spark: SparkSession, sf: str) -> DataFrame:
    return G.report_no_data({"flow": G.Grid(nodata=-9999.0), "subc": G.Grid()}, spark)


@query(closed("SELECT base AS outlet, count(*) AS n FROM c WHERE base IN (2, 6, 11) GROUP BY base", "cellnet").replace("WITH RECURSIVE ", "WITH RECURSIVE cellnet AS (SELECT subc_id, CASE WHEN subc_id % 40 = 0 THEN -1 ELSE subc_id - 1 END AS target, 1.0 AS length FROM net), "), "net")
def k10_upstream_cells(spark: SparkSession, sf: str) -> DataFrame:
    # 40 cells a row, flowing west to its first cell
    d = view(spark, sf, "net").select(F.expr("subc_id div 40").alias("cell_row"), (F.col("subc_id") % 40).alias("cell_col"), F.when(F.col("subc_id") % 40 == 0, 0).otherwise(16).alias("value"))
    outlets = spark.createDataFrame([(2, 0, 2), (6, 0, 6), (11, 0, 11)], "outlet long, cell_row long, cell_col long")
    return G.upstream_cells(d, outlets).groupBy("outlet").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT id, CAST(floor((90 - lat) / 0.5) AS BIGINT) AS r, CAST(floor((lon + 180) / 0.5) AS BIGINT) AS k FROM pts), s AS (SELECT cell_row AS sr, cell_col * 13 AS sk, zone FROM cells), b AS (SELECT p.*, CAST(floor(r / 11) AS BIGINT) + i AS bi, CAST(floor(k / 11) AS BIGINT) + j AS bj FROM p, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) c(j)), near AS (SELECT b.id, zone, sr, sk, (r - sr) * (r - sr) + (k - sk) * (k - sk) AS d FROM b JOIN s ON sr // 11 = bi AND sk // 11 = bj WHERE (r - sr) * (r - sr) + (k - sk) * (k - sk) <= 100) SELECT id, zone AS subc_id FROM (SELECT p.id, zone, row_number() OVER (PARTITION BY p.id ORDER BY d, sr, sk) AS nth FROM p LEFT JOIN near ON near.id = p.id) WHERE nth = 1", "pts", "cells")
def k11_snap_to_cells(spark: SparkSession, sf: str) -> DataFrame:
    streams = view(spark, sf, "cells").select("cell_row", (F.col("cell_col") * 13).alias("cell_col"), F.col("zone").alias("value"))
    return GEO.snap_to_cells(view(spark, sf, "pts"), streams, G.Grid(dx=0.5, dy=0.5), 10).select("id", "subc_id")


@query("SELECT id, user_id AS subc_id, round(greatest(0, least(1, (lon - (user_id % 360 - 180)) / 1.0)), 5) AS fraction FROM pts JOIN (SELECT event_id, user_id FROM events) ON event_id = id", "pts")
def k12_snap_to_own_segment(spark: SparkSession, sf: str) -> DataFrame:
    # each sub-catchment's line runs east over one degree, along the latitude of its point's row
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subc_id"))
    p = view(spark, sf, "pts").join(e, "id")
    x, y = F.col("subc_id") % 360 - 180, F.col("subc_id") % 170 - 85
    lines = e.select("subc_id").distinct().select("subc_id", F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), F.struct((x + 1).cast("double").alias("x"), y.cast("double").alias("y"))).alias("geom"))
    return GEO.snap_to_own_segment(p, lines).select("id", "subc_id", F.round("fraction", 5).alias("fraction"))


@query("WITH lake AS (SELECT DISTINCT zone AS lake_id, cell_row, cell_col FROM cells WHERE zone % 10 = 1), o AS (SELECT DISTINCT l.lake_id, l.cell_row + i AS cell_row, l.cell_col + j AS cell_col FROM lake l, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)), outer_ AS (SELECT o.* FROM o ANTI JOIN lake l ON o.lake_id = l.lake_id AND o.cell_row = l.cell_row AND o.cell_col = l.cell_col), hit AS (SELECT u.lake_id, c.cell_row, c.cell_col, c.zone AS subc_id, c.value AS flow FROM outer_ u JOIN cells c ON c.cell_row = u.cell_row AND c.cell_col = u.cell_col WHERE c.value IS NOT NULL), f AS (SELECT h.lake_id, h.subc_id, h.cell_row, h.cell_col, h.flow, max(n.value) AS flow_max FROM (SELECT hit.*, cell_row + i AS r, cell_col + j AS k FROM hit, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)) h JOIN cells n ON n.cell_row = r AND n.cell_col = k GROUP BY 1, 2, 3, 4, 5) SELECT lake_id, subc_id, flow_max FROM (SELECT *, row_number() OVER (PARTITION BY lake_id, subc_id ORDER BY flow_max DESC, flow DESC, cell_row, cell_col) AS k FROM f) WHERE k = 1", "cells")
def k16_lake_intersections(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "cells")
    lake = c.where("zone % 10 = 1").select(F.col("zone").alias("lake_id"), "cell_row", "cell_col")
    return G.lake_intersections(lake, c.select("cell_row", "cell_col", F.col("zone").alias("value")), c).select("lake_id", "subc_id", "flow_max")


@query("SELECT DISTINCT p_brand AS tile FROM part WHERE p_size IN (SELECT DISTINCT CAST(user_id % 7 AS INT) FROM events)")
def k19_tile_ids(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "events").select((F.col("user_id") % 7).cast("int").alias("reg_unit")).distinct()
    return L.tile_ids(units, table(spark, sf, "part").select(F.col("p_brand").alias("tile"), F.col("p_size").alias("reg_unit")))


_STRIP = "SELECT s_suppkey, CAST(s_suppkey % 10 AS DOUBLE) AS x0, CAST(s_suppkey % 7 AS DOUBLE) AS y0 FROM supplier"


@query(f"SELECT s_suppkey, greatest(x0, 2.5) AS xa, least(x0 + 4, 8.5) AS xb FROM ({_STRIP}) WHERE x0 <= 8.5 AND x0 + 4 >= 2.5 AND y0 BETWEEN 1 AND 5")
def k6_clip_lines(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").selectExpr("s_suppkey", "CAST(s_suppkey % 10 AS DOUBLE) AS x", "CAST(s_suppkey % 7 AS DOUBLE) AS y")
    lines = s.select("s_suppkey", F.array(F.struct("x", "y"), F.struct((F.col("x") + 4).alias("x"), "y")).alias("geom"))
    cut = GEO.clip_vectors(lines, (2.5, 1.0, 8.5, 5.0))
    return cut.select("s_suppkey", F.element_at("geom", 1)["x"].alias("xa"), F.element_at("geom", -1)["x"].alias("xb"))


@query("SELECT DISTINCT zone AS lake_id FROM cells WHERE cell_row BETWEEN 100 AND 160 AND zone % 4 = 1", "cells")
def k15_lakes_in_box(spark: SparkSession, sf: str) -> DataFrame:
    lakes = view(spark, sf, "cells").where("zone % 4 = 1")
    return G.crop(lakes, G.Grid(0.0, 0.0, 1.0, 1.0), 0.0, -161.0, 20.0, -100.0).select(F.col("zone").alias("lake_id")).distinct()


# --- catalog and models ------------------------------------------------------------------


@query("SELECT max(file_size) AS file_size FROM catalog WHERE contains(file_path, '/brand11_h01v01.zip')", "catalog")
def c6_tile_filesize(spark: SparkSession, sf: str) -> DataFrame:
    c = C.with_names(view(spark, sf, "catalog")).groupBy("file_name", "var").agg(F.max("file_size").alias("file_size"))
    known = c.where("file_name = 'brand11_h01v01.zip'")
    size = None if known.isEmpty() else C.tile_filesize(c, "brand11", "zip", "h01v01")
    return spark.createDataFrame([(size,)], "file_size long")


@query()
def m5_folds(spark: SparkSession, sf: str) -> DataFrame:
    return E.folds(view(spark, sf, "preds"), "doc_id").groupBy("fold", "observed").agg(F.count("*").alias("n"))


@query()
def m6_random_forest(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "attrs").withColumn("observed", (F.col("price_mean") > 150000).cast("int"))
    model = E.forest(a, ["price_min", "price_max", "n_orders"], trees=10)
    from pyspark.ml.feature import VectorAssembler

    scored = model.transform(VectorAssembler(inputCols=["price_min", "price_max", "n_orders"], outputCol="_x").transform(a))
    return scored.select("subc_id", "observed", F.col("prediction").cast("int").alias("predicted"))


# --- network pipelines ----------------------------------------------------------------------


@query(closed("SELECT n.subc_id, n.target, round(n.length, 2) AS length FROM c JOIN net n ON n.subc_id = c.stream WHERE base = 9 AND n.length > 3000"), "net")
def x4_stream_segments(spark: SparkSession, sf: str) -> DataFrame:
    net = N.RiverNetwork(view(spark, sf, "net"))
    up = N.closure(net, seeds=spark.createDataFrame([(9,)], "id long")).select(F.col("stream").alias("id"))
    return net.edges.join(up, "id").where("weight > 3000").select(F.col("id").alias("subc_id"), "target", F.round("weight", 2).alias("length"))


@query(closed("SELECT base AS subc_id, count(*) AS n, sum(stream)::BIGINT AS id_sum FROM c WHERE base IN (4, 9) GROUP BY base"), "net")
def x5_upstream_catchment(spark: SparkSession, sf: str) -> DataFrame:
    net = N.RiverNetwork(view(spark, sf, "net"))
    return N.closure(net, seeds=spark.createDataFrame([(4,), (9,)], "id long")).groupBy(F.col("base").alias("subc_id")).agg(F.count("*").alias("n"), F.sum("stream").alias("id_sum"))


@query(
    closed(
        """SELECT stream AS subc_id, code FROM c JOIN numbered ON trib = base
UNION ALL SELECT id, CAST(1 + 2 * (SELECT count(*) FROM numbered f WHERE f.pos < p.pos) AS INT) FROM (SELECT c.stream AS id, max(s.pos) AS pos FROM c JOIN stem s ON s.id = c.base GROUP BY 1) p WHERE id NOT IN (SELECT stream FROM c JOIN numbered ON trib = base)""",
        extra="""head AS (SELECT stream FROM c WHERE base = (SELECT subc_id FROM net WHERE target = -1) AND stream NOT IN (SELECT target FROM net) ORDER BY dist DESC, stream LIMIT 1),
way AS (SELECT base AS id, hops FROM c WHERE stream = (SELECT stream FROM head)),
stem AS (SELECT id, (SELECT max(hops) FROM way) - hops AS pos FROM way),
area AS (SELECT base, sum(n.length) AS up FROM c JOIN net n ON n.subc_id = c.stream GROUP BY 1),
four AS (SELECT n.subc_id AS trib, s.pos, a.up FROM net n JOIN stem s ON s.id = n.target JOIN area a ON a.base = n.subc_id WHERE n.subc_id NOT IN (SELECT id FROM stem) ORDER BY a.up DESC, n.subc_id LIMIT 4),
numbered AS (SELECT trib, pos, CAST(2 * row_number() OVER (ORDER BY pos, trib) AS INT) AS code FROM four)""",
    ),
    "net",
)
def g7_pfafstetter(spark: SparkSession, sf: str) -> DataFrame:
    return pfafstetter(N.RiverNetwork(view(spark, sf, "net")), "length").withColumnRenamed("id", "subc_id")


@query("WITH RECURSIVE s AS (SELECT DISTINCT subc_id AS dam FROM dams WHERE status = 'existing'), down(dam, subc_id, before) AS (SELECT dam, dam, 0.0::DOUBLE FROM s UNION ALL SELECT down.dam, n.target, down.before + n.length FROM down JOIN net n ON n.subc_id = down.subc_id WHERE n.target >= 0 AND down.before + n.length < 9000), z AS (SELECT DISTINCT subc_id FROM down) SELECT subc_id // 16 AS patch, round(sum(length), 2) AS len, round(sum(CASE WHEN subc_id IN (SELECT subc_id FROM z) THEN length ELSE 0 END), 2) AS overlap FROM net WHERE subc_id % 3 = 0 GROUP BY 1", "net", "dams")
def g16_patch_dam_overlap(spark: SparkSession, sf: str) -> DataFrame:
    net = N.RiverNetwork(view(spark, sf, "net"))
    starts = view(spark, sf, "dams").where("status = 'existing'").select(F.col("subc_id").alias("start"), F.col("subc_id").alias("id"), F.lit(0.0).alias("fraction")).distinct()
    zone = H.walk_budget(net, starts, 0.0, 9000.0).select("id").distinct().withColumn("hit", F.lit(True))
    each = net.edges.where("id % 3 = 0").select(F.expr("id div 16").alias("patch"), "id", "weight").join(zone, "id", "left")
    return each.groupBy("patch").agg(F.round(F.sum("weight"), 2).alias("len"), F.round(F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0.0)), 2).alias("overlap"))


@query("SELECT species, round(cur, 6) AS current, round(fut, 6) AS future, round((cur - fut) / cur * 100, 4) AS fi FROM (SELECT species, count(*) / 1000.0::DOUBLE AS cur, count(*) FILTER (subc_id % 3 = 0) / 1000.0::DOUBLE AS fut FROM occ GROUP BY 1)", "occ")
def g20_fragmentation_index(spark: SparkSession, sf: str) -> DataFrame:
    o = view(spark, sf, "occ")
    v = o.groupBy("species").agg((F.count("*") / F.lit(1000.0)).alias("pci")).withColumn("scenario", F.lit("current")).unionByName(o.where("subc_id % 3 = 0").groupBy("species").agg((F.count("*") / F.lit(1000.0)).alias("pci")).withColumn("scenario", F.lit("future")))
    t = H.fragmentation_index(v)
    return t.select("species", F.round("current", 6).alias("current"), F.round("future", 6).alias("future"), F.round("fi", 4).alias("fi"))


@query(closed("SELECT DISTINCT v AS subc_id FROM path", extra="m AS (SELECT a.stream AS i, b.stream AS j, max_by(a.base, -(a.hops + b.hops)) AS m FROM c a JOIN c b ON a.base = b.base AND a.stream < b.stream WHERE a.stream % 61 = 7 AND b.stream % 61 = 7 GROUP BY 1, 2), path AS (SELECT x.base AS v FROM m JOIN c x ON x.stream = i JOIN c y ON y.stream = x.base AND y.base = m UNION SELECT x.base FROM m JOIN c x ON x.stream = j JOIN c y ON y.stream = x.base AND y.base = m UNION SELECT stream FROM c WHERE base % 61 = 7 AND hops <= 1)"), "net")
def g25_spanning_subnetwork(spark: SparkSession, sf: str) -> DataFrame:
    net = N.RiverNetwork(view(spark, sf, "net"))
    return H.spanning_subnetwork(net, net.edges.where("id % 61 = 7").select("id"), 1).withColumnRenamed("id", "subc_id")


@query(
    "WITH RECURSIVE g AS (SELECT subc_id FROM attrs WHERE price_mean / 500000 >= 0.28), bad AS (SELECT subc_id, CASE WHEN target IN (SELECT subc_id FROM g) THEN -1 ELSE target END AS target, length FROM net WHERE subc_id NOT IN (SELECT subc_id FROM g)), "
    + CLOSURE.format("bad")
    + """, r AS (SELECT stream, max_by(base, hops) AS root FROM c GROUP BY stream),
fill AS (SELECT r.root FROM r JOIN net n ON n.subc_id = r.stream GROUP BY r.root HAVING sum(n.length) <= 9000 AND bool_or(r.stream IN (SELECT target FROM net WHERE subc_id IN (SELECT subc_id FROM g))) AND bool_or(n.target IN (SELECT subc_id FROM g))),
f AS (SELECT subc_id FROM g UNION SELECT stream FROM r JOIN fill USING (root)),
k AS (SELECT subc_id FROM f JOIN net n USING (subc_id) WHERE n.target IN (SELECT subc_id FROM f) OR subc_id IN (SELECT target FROM net WHERE subc_id IN (SELECT subc_id FROM f)))
SELECT subc_id, CAST(subc_id IN (SELECT subc_id FROM g) AS INT) AS suitable, CAST(subc_id IN (SELECT subc_id FROM f) AS INT) AS gap_filled, CAST(subc_id IN (SELECT subc_id FROM k) AS INT) AS isolated_removed FROM attrs""",
    "net",
    "attrs",
)
def b9_habitat_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Per segment: suitable at a stated threshold, gap-filled, and kept after isolated ones went."""
    net = N.RiverNetwork(view(spark, sf, "net"))
    score = view(spark, sf, "attrs").select(F.col("subc_id").alias("id"), (F.col("price_mean") / 500_000).alias("p"))
    good = score.where("p >= 0.28").select("id")
    filled = good.unionByName(H.fill_habitat_gaps(net, good, max_gap=9000.0))
    kept = H.drop_isolated(net, filled)
    flag = lambda df, n: df.distinct().withColumn(n, F.lit(1))
    out = score.select("id").join(flag(good, "suitable"), "id", "left").join(flag(filled, "gap_filled"), "id", "left").join(flag(kept, "isolated_removed"), "id", "left")
    return out.select(F.col("id").alias("subc_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("suitable", "gap_filled", "isolated_removed")])


@query("SELECT id AS site_id, 'Feature' AS kind, lon, lat FROM pts", "pts")
def s8_geojson_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "pts").withColumnRenamed("id", "site_id")
    f = L.points_geojson(p).select(F.from_json("feature", "type string, geometry struct<coordinates: array<double>>, properties struct<site_id: string>").alias("f"))
    return f.select(F.col("f.properties.site_id").cast("long").alias("site_id"), F.col("f.type").alias("kind"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def s4_delimited_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    from thalweg.plans.scratch import scratch_path
    from thalweg.sources.files import read_table

    path = scratch_path(spark, "delimited")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey").write.csv(path, header=True, sep=";")
    return read_table(spark, path, "o_orderkey long, o_custkey long", ";")


@query("SELECT o_custkey, count(*) AS n, max(w) AS top FROM (SELECT o_custkey, o_orderkey % 7 AS w FROM orders) GROUP BY 1")
def d_user_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 7).alias("w"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), N.stat_column(lambda c: F.max(c), "w").alias("top"))


