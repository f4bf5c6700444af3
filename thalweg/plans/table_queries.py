"""Registered queries over tables, rasters, points, catalogs and predictions, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thalweg.operators import catalog as C
from thalweg.operators import cleaning as L
from thalweg.operators import evaluate as E
from thalweg.operators import geometry as GEO
from thalweg.operators import grid as G
from thalweg.operators import tables as T
from thalweg.plans.fixtures import sql, table, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, *views)
        return f

    return add


# --- rasters -----------------------------------------------------------------

_AROUND = "(VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)"


@query("SELECT zone, count(value) AS data_cells, count(*) - count(value) AS nodata_cells, min(value) AS min, max(value) AS max, max(value) - min(value) AS range, round(avg(value), 6) AS mean, round(avg(abs(value)), 6) AS mean_abs, round(stddev_pop(value), 6) AS sd, round(var_pop(value), 5) AS var, round(100 * stddev_pop(value) / abs(avg(value)), 5) AS cv, sum(value) AS sum, sum(abs(value)) AS sum_abs FROM cells GROUP BY zone", "cells")
def k2_zonal_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = G.zonal_stats(view(spark, sf, "cells"))
    return t.select(*[F.round(c, 6 if c in ("mean", "mean_abs", "sd") else 5).alias(c) if c in ("mean", "mean_abs", "sd", "var", "cv") else c for c in t.columns])


@query("SELECT zone, count(value) AS data_cells, round(avg(value), 6) AS mean FROM cells WHERE zone % 5 = 2 GROUP BY zone", "cells")
def k2_zonal_subset(spark: SparkSession, sf: str) -> DataFrame:
    cells = view(spark, sf, "cells")
    t = G.zonal_stats(cells, zones=table(spark, sf, "supplier").where("s_suppkey % 5 = 2").select(F.col("s_suppkey").alias("zone")))
    return t.select("zone", "data_cells", F.round("mean", 6).alias("mean"))


_OLD_NEW = "SELECT CAST(p_partkey % 50 AS BIGINT) AS rast_val, max(CAST(p_size AS BIGINT)) AS new_val FROM part WHERE p_partkey % 50 < 35 GROUP BY 1"


def _reclass(remaining: str | None, rest: str):
    @query(f"SELECT cell_row, cell_col, CASE WHEN t.rast_val IS NOT NULL THEN new_val WHEN v IS NOT NULL THEN {rest} END AS value FROM (SELECT cell_row, cell_col, CAST(value AS BIGINT) AS v FROM cells) LEFT JOIN ({_OLD_NEW}) t ON t.rast_val = v", "cells")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        lookup = table(spark, sf, "part").where("p_partkey % 50 < 35").groupBy((F.col("p_partkey") % 50).alias("rast_val")).agg(F.max(F.col("p_size").cast("long")).alias("new_val"))
        return G.reclass(view(spark, sf, "cells"), lookup, remaining=remaining)

    name = f"k4_reclass_{remaining or 'null'}"
    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_reclass(None, "NULL")
_reclass("same", "v")
_reclass("value", "-9999")


@query("SELECT cell_row, cell_col, value FROM cells WHERE -180 + (cell_col + 0.5) * 0.5 BETWEEN -179.6 AND -178 AND 90 - (cell_row + 0.5) * 0.01 BETWEEN 80 AND 88", "cells")
def k5_crop(spark: SparkSession, sf: str) -> DataFrame:
    return G.crop(view(spark, sf, "cells"), G.Grid(dx=0.5, dy=0.01), -179.6, 80, -178, 88).select("cell_row", "cell_col", "value")


@query("SELECT cell_row, cell_col, CASE WHEN b IS NOT NULL THEN b ELSE a END AS value FROM (SELECT cell_row, cell_col, max(CASE WHEN k = 0 THEN value END) AS a, max(CASE WHEN k = 1 THEN value END) AS b FROM (SELECT cell_row, cell_col, value, 0 AS k FROM cells WHERE cell_row % 3 < 2 UNION ALL SELECT cell_row, cell_col, value * 10, 1 FROM cells WHERE cell_row % 3 > 0) GROUP BY 1, 2)", "cells")
def k7_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    cells = view(spark, sf, "cells")
    return G.mosaic([cells.where("cell_row % 3 < 2"), cells.where("cell_row % 3 > 0").withColumn("value", F.col("value") * 10)])


@query(f"WITH o AS (SELECT cell_row, cell_col, cell_row + i AS r, cell_col + j AS k FROM cells, {_AROUND} WHERE value IS NOT NULL) SELECT o.cell_row, o.cell_col, max(n.value) AS focal_max, round(avg(n.value), 6) AS focal_mean FROM o JOIN cells n ON n.cell_row = r AND n.cell_col = k WHERE n.value IS NOT NULL GROUP BY 1, 2", "cells")
def k20_focal(spark: SparkSession, sf: str) -> DataFrame:
    t = G.focal(view(spark, sf, "cells"))
    return t.select("cell_row", "cell_col", "focal_max", F.round("focal_mean", 6).alias("focal_mean"))


@query(f"WITH lake AS (SELECT cell_row, cell_col FROM cells WHERE value IS NOT NULL), o AS (SELECT cell_row, cell_col, cell_row + i AS r, cell_col + j AS k FROM lake, {_AROUND}) SELECT o.cell_row, o.cell_col FROM o JOIN lake n ON n.cell_row = r AND n.cell_col = k GROUP BY 1, 2 HAVING count(*) < 9", "cells")
def k16_lake_edge(spark: SparkSession, sf: str) -> DataFrame:
    return G.edge_cells(view(spark, sf, "cells").where("value is not null"))


@query("SELECT cell_row, cell_col, nullif(value, 36.0) AS value FROM cells", "cells")
def k9_set_no_data(spark: SparkSession, sf: str) -> DataFrame:
    return G.set_no_data(view(spark, sf, "cells"), 36.0).select("cell_row", "cell_col", "value")


@query("SELECT DISTINCT value FROM cells WHERE value IS NOT NULL", "cells")
def k1_raster_values(spark: SparkSession, sf: str) -> DataFrame:
    return G.extract_ids(view(spark, sf, "cells"))


@query("SELECT id, lon, lat, value AS subcatchment_id FROM pts LEFT JOIN cells ON cell_row = CAST(floor((90 - lat) / 0.5) AS BIGINT) AND cell_col = CAST(floor((lon + 180) / 60) AS BIGINT)", "pts", "cells")
def j16_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    points = view(spark, sf, "pts").select("id", "lon", "lat")
    return G.extract_ids(view(spark, sf, "cells"), points, G.Grid(dx=60.0, dy=0.5))


@query("SELECT DISTINCT CAST(value AS BIGINT) AS reg_unit FROM pts JOIN cells ON cell_row = CAST(floor((90 - lat) / 0.5) AS BIGINT) AND cell_col = CAST(floor((lon + 180) / 60) AS BIGINT) WHERE value <> 0", "pts", "cells")
def k18_regional_units(spark: SparkSession, sf: str) -> DataFrame:
    return L.regional_units(view(spark, sf, "pts"), view(spark, sf, "cells"), G.Grid(dx=60.0, dy=0.5)).select(F.col("reg_unit").cast("long").alias("reg_unit"))


@query("SELECT zone, min(90 - (cell_row + 0.5) * 0.01) AS ymin, count(*) AS cells FROM cells GROUP BY zone", "cells")
def x6_basin_boxes(spark: SparkSession, sf: str) -> DataFrame:
    t = G.basin_polygon(view(spark, sf, "cells"), G.Grid(dx=0.5, dy=0.01), "zone")
    return t.select("zone", "ymin", "cells")


# --- prediction and model tables ----------------------------------------------


@query("SELECT i.subc_id, round(a.price_mean, 2) AS price_mean, round(a.price_max, 2) AS price_max, b.n_orders AS count_n_orders FROM (SELECT DISTINCT o_custkey AS subc_id FROM orders WHERE o_custkey % 3 = 0) i LEFT JOIN attrs a USING (subc_id) LEFT JOIN (SELECT subc_id, n_orders FROM attrs WHERE tile < 3) b USING (subc_id)", "attrs")
def b1_predict_table(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "attrs")
    tiles = [a.where(F.col("tile") == k).select("subc_id", F.col("price_mean").alias("mean"), F.col("price_max").alias("max")) for k in range(4)]
    tiles.append(tiles[0])  # an overlap: the first tile's row stays
    counts = [a.where(F.col("tile") == k).select("subc_id", "n_orders") for k in range(3)]
    ids = table(spark, sf, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("subc_id"))
    return T.predict_table(ids, {"price": tiles, "count": counts}).select("subc_id", "price_mean", "price_max", "count_n_orders")


@query("SELECT a.subc_id, 1 AS pres_abs, a.price_mean FROM attrs a WHERE a.subc_id IN (SELECT subc_id FROM occ WHERE species = '2-HIGH' AND subc_id <> 0)", "attrs", "occ")
def b2_modelfit_table(spark: SparkSession, sf: str) -> DataFrame:
    points = view(spark, sf, "occ").where("species = '2-HIGH'")
    return T.modelfit_table(points, view(spark, sf, "attrs").select("subc_id", "price_mean"))


@query()
def b3_pseudo_absences(spark: SparkSession, sf: str) -> DataFrame:
    points = view(spark, sf, "occ").where("species = '2-HIGH' and subc_id % 9 = 0")
    return T.modelfit_table(points, view(spark, sf, "attrs").select("subc_id", "price_mean"), 50)


@query("SELECT s_suppkey AS site_id, p, n_dam_in_licence, round(p / n_dam_in_licence, 4) AS p_dam FROM (SELECT *, CASE WHEN lic IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY lic) END AS n_dam_in_licence FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY s_nationkey, s_suppkey) AS k FROM (SELECT s_suppkey, s_nationkey, abs(s_acctbal) AS p, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 6 END AS lic, round((s_suppkey % 20) / 7.0, 4) AS x, round((s_suppkey % 5) / 3.0, 4) AS y FROM supplier)) WHERE k = 1)")
def b4_dam_registry(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site_id"), "s_nationkey", F.abs("s_acctbal").alias("p"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 6).alias("licence"), ((F.col("s_suppkey") % 20) / 7.0).alias("lon"), ((F.col("s_suppkey") % 5) / 3.0).alias("lat"))
    return L.dam_registry(s, "s_nationkey", "p").select("site_id", "p", "n_dam_in_licence", F.round("p_dam", 4).alias("p_dam"))


@query("SELECT event_id, y FROM (SELECT event_id, CASE WHEN user_id % 11 = 0 THEN NULL ELSE 1990 + user_id % 30 END AS y, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 4) / 100.0 END AS pr, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 301 ELSE event_id % 1500 END AS u FROM events) WHERE y IS NOT NULL AND (pr IS NULL OR pr < 0.01) AND (u IS NULL OR (u <= 1000 AND u NOT IN (301, 3036, 999, 9999)))")
def b5_occurrence_metadata(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.expr("CASE WHEN user_id % 11 = 0 THEN NULL ELSE 1990 + user_id % 30 END").alias("year"), F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 4) / 100.0 END").alias("coordinatePrecision"), F.expr("CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 301 ELSE event_id % 1500 END").alias("coordinateUncertaintyInMeters"))
    return L.occurrence_metadata(e).select("event_id", F.col("year").alias("y"))


@query("SELECT subc_id, round(greatest(1e-6, (price_mean - lo) / (hi - lo)), 8) AS price_norm FROM attrs, (SELECT min(price_mean) AS lo, max(price_mean) AS hi FROM attrs)", "attrs")
def b6_cost_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return T.normalise(view(spark, sf, "attrs"), "price_mean").select("subc_id", F.round("price_mean_norm", 8).alias("price_norm"))


@query("SELECT subc_id AS pu, species, CASE WHEN n >= 2 THEN CAST(n AS DOUBLE) ELSE 0.5 END AS amount FROM (SELECT subc_id, species, count(*) AS n FROM occ GROUP BY 1, 2)", "occ")
def b7_species_amounts(spark: SparkSession, sf: str) -> DataFrame:
    n = view(spark, sf, "occ").groupBy(F.col("subc_id").alias("pu"), "species").agg(F.count("*").alias("n"))
    return n.select("pu", "species", F.when(F.col("n") >= 2, F.col("n").cast("double")).otherwise(0.5).alias("amount"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.v AS m1, b.v AS m2, CAST((a.v IS NOT NULL) AS INT) + CAST((b.v IS NOT NULL) AS INT) AS n_models, round((coalesce(a.v, 0) + coalesce(b.v, 0)) / (CAST((a.v IS NOT NULL) AS INT) + CAST((b.v IS NOT NULL) AS INT)), 9) AS ens_mean FROM (SELECT doc_id, n_chars / 100000.0 AS v FROM documents WHERE doc_id % 3 < 2) a FULL JOIN (SELECT doc_id, quality * 0.5 AS v FROM labels) b ON a.doc_id = b.doc_id")
def b8_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").where("doc_id % 3 < 2").select("doc_id", (F.col("n_chars") / F.lit(100000.0)).alias("v"))
    b = table(spark, sf, "labels").select("doc_id", (F.col("quality") * F.lit(0.5)).alias("v"))
    return T.ensemble({"m1": a, "m2": b}, "doc_id", "v").withColumn("ens_mean", F.round("ens_mean", 9))


# --- catalog -------------------------------------------------------------------

_VAR = "regexp_replace(regexp_extract(file_path, '[^/]+$'), '_[^_]+$', '')"


@query(f"SELECT {_VAR} AS var, count(DISTINCT regexp_extract(file_path, '_(h\\d\\dv\\d\\d)\\.', 1)) AS tiles, count(*) AS files, sum(file_size)::BIGINT AS bytes FROM catalog GROUP BY 1", "catalog")
def c1_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.dataset_summary(C.with_names(view(spark, sf, "catalog")))


@query("SELECT count(*) AS files, count(*) - count(s) AS missing, coalesce(sum(s), 0)::BIGINT AS bytes FROM (SELECT v || '_' || t || '.zip' AS f FROM (VALUES ('brand11'), ('brand12'), ('brand99')) a(v), (VALUES ('h01v01'), ('h02v02'), ('h20v02')) b(t)) LEFT JOIN (SELECT regexp_extract(file_path, '[^/]+$') AS f, max(file_size) AS s FROM catalog GROUP BY 1) USING (f)", "catalog")
def c5_download_size(spark: SparkSession, sf: str) -> DataFrame:
    return C.download_size(C.with_names(view(spark, sf, "catalog")), ["brand11", "brand12", "brand99"], ["h01v01", "h02v02", "h20v02"])


@query(f"SELECT DISTINCT {_VAR} AS var FROM catalog WHERE contains(file_path, 'brand1')", "catalog")
def c4_variables(spark: SparkSession, sf: str) -> DataFrame:
    return C.variables(C.with_names(view(spark, sf, "catalog")), "brand1")


@query("SELECT file_name, regexp_extract(file_name, '^(c\\d+)_', 1) AS base_var, CAST(regexp_extract(file_name, '_(\\d{4})_', 1) AS INT) AS year, regexp_extract(file_name, '_(h\\d\\dv\\d\\d)', 1) AS tile FROM (SELECT 'c' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '_' || CAST(1992 + p_partkey % 20 AS VARCHAR) || '_h01v' || lpad(CAST(p_partkey % 18 AS VARCHAR), 2, '0') || '.zip' AS file_name FROM part)")
def c3_land_cover_names(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.concat(F.lit("lc/"), F.expr("'c' || lpad(cast(p_size as string), 2, '0') || '_' || cast(1992 + p_partkey % 20 as string) || '_h01v' || lpad(cast(p_partkey % 18 as string), 2, '0') || '.zip'")).alias("file_path"), F.lit(1).alias("file_size"))
    return C.land_cover_parts(C.with_names(part)).select("file_name", "base_var", "year", "tile")


@query("SELECT file_name, 'bio' || split_part(file_name, '_', 1)[4:] AS base_var, split_part(file_name, '_', 2) AS period, split_part(file_name, '_', 3) AS model, split_part(file_name, '_', 4) AS scenario, split_part(file_name, '_', 5) AS version FROM (SELECT 'bio' || CAST(p_size AS VARCHAR) || '_2041-2070_m-' || CAST(p_partkey % 3 AS VARCHAR) || '_ssp' || CASE WHEN p_partkey % 2 = 0 THEN '126' ELSE '585' END || '_V.2.1_h00v02.zip' AS file_name FROM part)")
def c2_projected_names(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.expr("'bio' || cast(p_size as string) || '_2041-2070_m-' || cast(p_partkey % 3 as string) || '_ssp' || case when p_partkey % 2 = 0 then '126' else '585' end || '_V.2.1_h00v02.zip'").alias("file_path"), F.lit(1).alias("file_size"))
    return C.projected_parts(C.with_names(part)).select("file_name", "base_var", "period", "model", "scenario", "version")


# --- evaluation ----------------------------------------------------------------

_GRID = "WITH t AS (SELECT unnest(range(101)) / 100.0 AS t), s AS (SELECT t, count(*) FILTER (observed = 1 AND score >= t - 1e-11)::DOUBLE AS tp, count(*) FILTER (observed = 1 AND score < t - 1e-11)::DOUBLE AS fn, count(*) FILTER (observed = 0 AND score >= t - 1e-11)::DOUBLE AS fp, count(*) FILTER (observed = 0 AND score < t - 1e-11)::DOUBLE AS tn FROM t, preds GROUP BY t) "


@query(_GRID + "SELECT CAST(t AS DOUBLE) AS t, round(tp / (tp + fn) + tn / (tn + fp) - 1, 8) AS tss FROM s", "preds")
def m1_tss_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return E.tss_sweep(view(spark, sf, "preds")).withColumn("tss", F.round("tss", 8))


@query(_GRID + "SELECT CAST(t AS DOUBLE) AS t, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 8) END AS mcc FROM s", "preds")
def m2_mcc_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return E.mcc_sweep(view(spark, sf, "preds")).withColumn("mcc", F.round("mcc", 8))


@query("SELECT round(avg(CASE WHEN a.score < p.score THEN 1.0 ELSE 0.0 END), 8) AS auc FROM preds p, preds a WHERE p.observed = 1 AND a.observed = 0", "preds")
def m3_auc(spark: SparkSession, sf: str) -> DataFrame:
    return E.auc(view(spark, sf, "preds")).withColumn("auc", F.round("auc", 8))


@query(_GRID + "SELECT CAST(t AS DOUBLE) AS t, round(tp / (tp + fn) + tn / (tn + fp) - 1, 8) AS tss FROM s ORDER BY 2 DESC, 1 LIMIT 1", "preds")
def m1_best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return E.best_threshold(E.tss_sweep(view(spark, sf, "preds")), "tss").withColumn("tss", F.round("tss", 8))


@query("SELECT 'price_mean' AS a, 'price_min' AS b, round(corr(price_mean, price_min), 8) AS r FROM attrs UNION ALL SELECT 'price_mean', 'n_orders', round(corr(price_mean, n_orders), 8) FROM attrs UNION ALL SELECT 'price_min', 'n_orders', round(corr(price_min, n_orders), 8) FROM attrs", "attrs")
def a14_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return E.correlations(view(spark, sf, "attrs"), ["price_mean", "price_min", "n_orders"]).withColumn("r", F.round("r", 8))


@query()
def a15_stepwise_vif(spark: SparkSession, sf: str) -> DataFrame:
    left = E.stepwise_vif(view(spark, sf, "attrs"), ["price_mean", "price_min", "price_max", "n_orders"], 3.0)
    return spark.createDataFrame(left, "variable string, vif double")


@query("SELECT round(quantile_cont(price_mean, 0.1), 6) AS q10, round(quantile_cont(price_mean, 0.5), 6) AS q50, round(quantile_cont(price_mean, 0.9), 6) AS q90 FROM attrs", "attrs")
def a13_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = E.quantiles(view(spark, sf, "attrs"), "price_mean", [0.1, 0.5, 0.9])
    return q.select(*[F.round(F.element_at("q", k + 1), 6).alias(n) for k, n in enumerate(("q10", "q50", "q90"))])


@query("WITH q AS (SELECT quantile_cont(price_mean, [0.25, 0.5, 0.75]) AS q FROM attrs) SELECT subc_id, CASE WHEN price_mean <= q[1] THEN 0.3 WHEN price_mean <= q[2] THEN 0.5 WHEN price_mean <= q[3] THEN 0.7 ELSE 0.9 END AS prob FROM attrs, q", "attrs")
def w13_quantile_classes(spark: SparkSession, sf: str) -> DataFrame:
    return E.quantile_classes(view(spark, sf, "attrs"), "price_mean", [0.3, 0.5, 0.7, 0.9], "prob").select("subc_id", "prob")


@query("WITH p AS (SELECT CAST(subc_id AS DOUBLE) AS x, price_max AS y FROM attrs), e AS (SELECT min_by(x, x) AS ax, min_by(y, x) AS ay, max_by(x, x) AS bx, max_by(y, x) AS by_ FROM p) SELECT x, y, round(abs((by_ - ay) * (x - ax) - (bx - ax) * (y - ay)) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 6) AS distance FROM p, e ORDER BY abs((by_ - ay) * (x - ax) - (bx - ax) * (y - ay)) DESC, x LIMIT 1", "attrs")
def a21_knee(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "attrs").select(F.col("subc_id").cast("double").alias("x"), F.col("price_max").alias("y"))
    return E.knee(p, "x", "y").withColumn("distance", F.round("distance", 6))


@query("WITH g AS (SELECT tile % 2 AS g, count(price_mean) AS n, avg(price_mean) AS m, var_samp(price_mean) AS v FROM attrs GROUP BY 1) SELECT a.g AS a, b.g AS b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM g a JOIN g b ON a.g < b.g", "attrs")
def a19_welch(spark: SparkSession, sf: str) -> DataFrame:
    t = E.welch(view(spark, sf, "attrs").withColumn("g", F.col("tile") % 2), "g", "price_mean")
    return t.select("a", "b", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("SELECT round(regr_slope(ln(price_max), ln(price_mean)), 8) AS slope, round(regr_intercept(ln(price_max), ln(price_mean)), 6) AS intercept, round(regr_r2(ln(price_max), ln(price_mean)), 8) AS r2, count(*) AS n FROM attrs", "attrs")
def m9_linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    t = E.linear_fit(view(spark, sf, "attrs").select(F.ln("price_mean").alias("x"), F.ln("price_max").alias("y")), "x", "y")
    return t.select(F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 8).alias("r2"), "n")


# --- points --------------------------------------------------------------------


@query("SELECT a.id AS \"from\", b.id AS \"to\", round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 1) AS dist FROM sites a JOIN sites b ON a.id < b.id", "sites")
def k13_point_distance(spark: SparkSession, sf: str) -> DataFrame:
    return GEO.point_distances(view(spark, sf, "sites")).withColumn("dist", F.round(F.col("dist") + 0.0005, 1))


@query("SELECT a.basin AS g, a.id AS \"from\", b.id AS \"to\", round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 1) AS dist FROM sites a JOIN sites b ON a.basin = b.basin AND a.id < b.id", "sites")
def k14_distance_by_basin(spark: SparkSession, sf: str) -> DataFrame:
    return GEO.point_distances(view(spark, sf, "sites"), "basin").withColumn("dist", F.round(F.col("dist") + 0.0005, 1))


_BOX = "SELECT CAST(unnest(range(12)) AS BIGINT) AS k"


@query(f"SELECT id, k AS poly_id FROM pts JOIN ({_BOX}) ON lon > k * 25 - 150 AND lon <= k * 25 - 150 + 15 AND lat > k * 5 - 40 AND lat < k * 5 - 40 + 12 WHERE NOT (lon = k * 25 - 150 + 15)", "pts")
def j18_points_in_polygons(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    corner = lambda dx, dy: F.struct((k * 25 - 150 + dx).cast("double").alias("x"), (k * 5 - 40 + dy).cast("double").alias("y"))
    polygons = spark.range(12).withColumnRenamed("id", "k").select(k.alias("poly_id"), F.array(corner(0, 0), corner(15, 0), corner(15, 12), corner(0, 12)).alias("ring"))
    return GEO.points_in_polygons(view(spark, sf, "pts"), polygons, 5.0, border=False)


_LINES = "SELECT s_suppkey AS subc_id, CAST(1 + s_suppkey % 4 AS INT) AS strahler, CAST(s_suppkey % 150 - 179.8 AS DOUBLE) AS x, CAST(s_suppkey % 150 - 84.5 AS DOUBLE) AS y FROM supplier"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS subc_id", "CAST(1 + s_suppkey % 4 AS INT) AS strahler", "CAST(s_suppkey % 150 - 179.8 AS DOUBLE) AS x", "CAST(s_suppkey % 150 - 84.5 AS DOUBLE) AS y")
    return s.select("subc_id", "strahler", F.array(F.struct("x", "y"), F.struct((F.col("x") + 0.5).alias("x"), F.col("y").alias("y"))).alias("geom"))


_FOOT = """f AS (SELECT p.id, l.subc_id, l.strahler, greatest(0, least(1, ((lon - x) * cos(radians(lat)) * 0.5 * cos(radians(lat))) / (0.25 * cos(radians(lat)) * cos(radians(lat))))) AS t, lon, lat, x, y FROM pts p, l WHERE abs(lat - y) < 1.5 AND lon BETWEEN x - 6 AND x + 6.5),
d AS (SELECT *, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x + t * 0.5 - lon) / 2), 2)))) AS dist FROM f)"""


@query(f"WITH l AS ({_LINES}), {_FOOT} SELECT id, subc_id, round(dist, 2) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, subc_id) AS k FROM d WHERE dist <= 100000 AND strahler >= 2) WHERE k = 1", "pts")
def x2_snapped_points(spark: SparkSession, sf: str) -> DataFrame:
    out = GEO.nearest_segment(view(spark, sf, "pts"), _lines(spark, sf), 100_000.0, where=F.col("strahler") >= 2)
    return out.select("id", "subc_id", F.round("distance_metres", 2).alias("dist"))


@query(f"WITH l AS ({_LINES}), {_FOOT}, e AS (SELECT d.*, v.level, row_number() OVER (PARTITION BY id, v.level ORDER BY dist, subc_id) AS k FROM d JOIN (VALUES (4), (3), (2)) v(level) ON strahler >= v.level WHERE dist < 90000) SELECT id, level, subc_id, round(dist, 2) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level DESC) AS z FROM e WHERE k = 1) WHERE z = 1", "pts")
def x3_snap_cascade(spark: SparkSession, sf: str) -> DataFrame:
    out = GEO.snap_cascade(view(spark, sf, "pts"), _lines(spark, sf), (4, 3, 2), 90_000.0)
    return out.select("id", "level", "subc_id", F.round("distance_metres", 2).alias("dist"))


@query("SELECT k, CAST(regexp_extract(w, '(-?\\d+\\.\\d+)\\s+(-?\\d+\\.\\d+)', 1) AS DOUBLE) AS lon, CAST(regexp_extract(w, '(-?\\d+\\.\\d+)\\s+(-?\\d+\\.\\d+)', 2) AS DOUBLE) AS lat FROM (SELECT event_id AS k, 'POINT (' || CAST(user_id AS VARCHAR) || '.25 -' || CAST(event_id % 90 AS VARCHAR) || '.5)' AS w FROM events)")
def s10_wkt_points(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = GEO.wkt_point(F.col("w"))
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), F.expr("'POINT (' || cast(user_id as string) || '.25 -' || cast(event_id % 90 as string) || '.5)'").alias("w")).select("k", lon.alias("lon"), lat.alias("lat"))


@query("SELECT id, lon, lat, kind FROM (SELECT id, CASE WHEN id % 4 = 0 THEN lat ELSE lon END AS a, CASE WHEN id % 4 = 0 THEN lon ELSE lat END AS b, lon, lat, kind FROM pts) WHERE lon BETWEEN -150 AND -100 AND lat BETWEEN -55 AND 5", "pts")
def p11_swap_inverted(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "pts").where("lon between -150 and -100 and lat between -55 and 5").selectExpr("id", "CASE WHEN id % 4 = 0 THEN lat ELSE lon END AS lon", "CASE WHEN id % 4 = 0 THEN lon ELSE lat END AS lat", "kind")
    return L.swap_inverted(p, "lon", "lat", (-150, -55, -100, 5))


@query("SELECT p.id, p.lon, p.lat, m.v FROM pts p LEFT JOIN (SELECT round(lon, 1) AS x, round(lat, 1) AS y, min(v) AS v FROM pts WHERE id % 2 = 0 GROUP BY 1, 2) m ON m.x = round(p.lon, 1) AND m.y = round(p.lat, 1)", "pts")
def j10_join_rounded(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "pts")
    return L.join_by_coordinates(p.select("id", "lon", "lat"), p.where("id % 2 = 0").select("lon", "lat", "v"), 1)


# --- filters, joins, sets, windows, reshaping ------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def p1_id_filter(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def p2_anti_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").join(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("SELECT o_orderkey, o_custkey, o_orderdate, species FROM (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority AS species, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n >= 15")
def p15_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return L.frequent(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderpriority").alias("species")), "o_custkey", 15)


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS class, nullif(o_orderstatus, 'O') AS status FROM orders")
def p12_recode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") < 50000, "low").when(F.col("o_totalprice") < 200000, "mid").otherwise("high").alias("class"), F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"))


@query("SELECT subc_id, round(price_mean / 10, 4) AS price_mean, round(price_min / 10, 4) AS price_min, round(price_max / 10, 4) AS price_max, n_orders FROM attrs", "attrs")
def p14_rescale(spark: SparkSession, sf: str) -> DataFrame:
    return T.rescale(view(spark, sf, "attrs").drop("tile"), {"^price_": lambda c: F.round(c / 10, 4)})


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j5_left_chain(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT subc_id, a.n AS n_a, b.n AS n_b FROM (SELECT subc_id, count(*) AS n FROM occ WHERE species = '1-URGENT' GROUP BY 1) a FULL JOIN (SELECT subc_id, count(*) AS n FROM occ WHERE species = '5-LOW' GROUP BY 1) b USING (subc_id)", "occ")
def j6_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    o = view(spark, sf, "occ")
    each = lambda s, n: o.where(F.col("species") == s).groupBy("subc_id").agg(F.count("*").alias(n))
    return each("1-URGENT", "n_a").join(each("5-LOW", "n_b"), "subc_id", "full")


@query("SELECT subc_id, tile, price_mean, n FROM attrs LEFT JOIN (SELECT subc_id, tile, n_orders AS n FROM attrs WHERE n_orders > 9) USING (subc_id, tile)", "attrs")
def j12_natural_left(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "attrs")
    return T.natural_left(a.select("subc_id", "tile", "price_mean"), a.where("n_orders > 9").select("subc_id", "tile", F.col("n_orders").alias("n")))


@query("SELECT count(*) FILTER (a AND b) AS shared, count(*) FILTER (NOT b) AS only_a, count(*) FILTER (NOT a) AS only_b, round(count(*) FILTER (a AND b) / count(*), 8) AS jaccard FROM (SELECT subc_id, bool_or(species = '1-URGENT') AS a, bool_or(species = '5-LOW') AS b FROM occ WHERE species IN ('1-URGENT', '5-LOW') GROUP BY 1)", "occ")
def a18_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    o = view(spark, sf, "occ")
    return T.jaccard(o.where("species = '1-URGENT'"), o.where("species = '5-LOW'"), "subc_id").withColumn("jaccard", F.round("jaccard", 8))


@query("SELECT 'price_mean' AS \"column\", count(*) FILTER (price_mean > 0) AS positive FROM attrs UNION ALL SELECT 'n_orders', count(*) FILTER (n_orders > 0) FROM attrs", "attrs")
def a11_positive_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.positive_counts(view(spark, sf, "attrs"), ["price_mean", "n_orders"])


@query("SELECT 'zone' AS \"column\", count(*) - count(zone) AS nulls FROM cells UNION ALL SELECT 'value', count(*) - count(value) FROM cells", "cells")
def a12_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.null_counts(view(spark, sf, "cells").select("zone", "value"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def a6_dissolve(spark: SparkSession, sf: str) -> DataFrame:
    return T.dissolve(table(spark, sf, "customer").select("c_nationkey", F.col("c_mktsegment").alias("segments")), "c_nationkey")


@query("SELECT subc_id, string_agg(CAST(site_id AS VARCHAR), '; ' ORDER BY site_id) AS sites FROM occ GROUP BY 1", "occ")
def a10_listagg(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT subc_id, listagg(cast(site_id AS string), '; ') WITHIN GROUP (ORDER BY site_id) AS sites FROM {o} GROUP BY subc_id", o=view(spark, sf, "occ"))


@query("SELECT c_mktsegment, round(min(c_acctbal), 2) AS lo, round(max(c_acctbal), 2) AS hi, round(median(c_acctbal), 2) AS med, round(avg(c_acctbal), 2) AS mean, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def a8_summary(spark: SparkSession, sf: str) -> DataFrame:
    b = "c_acctbal"
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.round(F.min(b), 2).alias("lo"), F.round(F.max(b), 2).alias("hi"), F.round(F.median(b), 2).alias("med"), F.round(F.avg(b), 2).alias("mean"), F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def w1_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    return T.keep_best(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("SELECT s_suppkey, dense_rank() OVER (ORDER BY s_nationkey DESC) AS r, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier")
def w3_ranks(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    s = table(spark, sf, "supplier")
    # ranks of the few nations that occur are joined, positions come from per-range counts
    ranks = nations.join(s.select("s_nationkey").distinct(), "s_nationkey", "left_semi").withColumn("r", F.dense_rank().over(W.orderBy(F.desc("s_nationkey"))).cast("long"))
    n = T.row_numbers(s.withColumn("_d", -F.col("s_acctbal")), ["_d", "s_suppkey"])
    return n.join(F.broadcast(ranks), "s_nationkey").select("s_suppkey", "r", F.col("row_no").alias("n"))


@query("SELECT p_brand, p_partkey, p_retailprice, sum(p_retailprice) OVER (PARTITION BY p_brand) AS total, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_size < 10")
def w5_group_totals(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where("p_size < 10").select("p_brand", "p_partkey", "p_retailprice")
    return p.join(p.groupBy("p_brand").agg(F.sum("p_retailprice").alias("total"), F.count("*").alias("n")), "p_brand")


@query("SELECT user_id, event_id, n FROM (SELECT user_id, event_id, value, count(*) OVER (PARTITION BY user_id) AS n, min(value) OVER (PARTITION BY user_id) AS m FROM events) WHERE value = m")
def w6_nearest_per_group(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    m = e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    return e.join(m, ["user_id", "value"]).select("user_id", "event_id", "n")


@query("SELECT user_id, event_id, coalesce(code, (SELECT NULL)) AS code FROM (SELECT user_id, event_id, first_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS code FROM (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN event_id END AS c FROM events))")
def w8_fill_upward(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_id")).alias("c"))
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.currentRow, W.unboundedFollowing)
    return e.select("user_id", "event_id", F.first("c", ignorenulls=True).over(w).alias("code"))


@query("SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 100) + 1 AS BIGINT) AS chunk FROM customer")
def r5_split_table(spark: SparkSession, sf: str) -> DataFrame:
    return T.chunked(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 100).select("c_custkey", "chunk")


@query("SELECT subc_id, name, value FROM (SELECT subc_id, price_mean, price_min, price_max FROM attrs) UNPIVOT (value FOR name IN (price_mean, price_min, price_max))", "attrs")
def r1_pivot_longer(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "attrs").unpivot(["subc_id"], ["price_mean", "price_min", "price_max"], "name", "value")


@query("SELECT subc_id, count(*) FILTER (species = '1-URGENT') AS urgent, count(*) FILTER (species = '2-HIGH') AS high FROM occ GROUP BY 1", "occ")
def r2_pivot_wider(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "occ").groupBy("subc_id").pivot("species", ["1-URGENT", "2-HIGH"]).agg(F.count("site_id"))
    return p.select("subc_id", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(n) for c, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"))])


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_nationkey < 10")
def u5_union(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).unionByName(table(spark, sf, "customer").where("c_nationkey < 10").select(F.col("c_nationkey").alias("k"))).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u3_setdiff(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def u4_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("SELECT o_orderkey, o_custkey, NULL AS l_partkey FROM orders UNION ALL SELECT l_orderkey, NULL, l_partkey FROM lineitem")
def u2_union_fill(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT subc_id, tile FROM attrs WHERE tile < 2 UNION ALL SELECT subc_id, tile FROM attrs WHERE tile = 1", "attrs")
def u8_union_common(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "attrs")
    return T.union_common(a.where("tile < 2").select("subc_id", "tile", "price_min"), a.where("tile = 1").select("tile", "subc_id", "price_max"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ORDER BY c_nationkey DESC, c_mktsegment LIMIT 7")
def o2_top_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct().orderBy(F.desc("c_nationkey"), "c_mktsegment").limit(7)


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS k FROM orders) WHERE k = 1")
def o7_priority_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return T.priority_dedupe(table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query()
def o8_random_sample(spark: SparkSession, sf: str) -> DataFrame:
    return T.sample_rows(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), 40, ["c_custkey"], 7)


@query("SELECT target AS basin_id, count(*) AS num_subcatchments, sum(subc_id)::BIGINT AS id_sum FROM net WHERE target IN (3, 5, 8) GROUP BY 1", "net")
def x1_basin_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = view(spark, sf, "net").select("subc_id", F.col("target").alias("basin_id"), F.lit(1).alias("strahler"))
    return L.basin_ids(n, [3, 5, 8]).select("basin_id", "num_subcatchments", F.aggregate("subc_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS basin_id, n_nationkey AS subc_id FROM nation")
def x8_parse_results(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("ids"))
    one = n.select(F.struct(F.col("n_regionkey").alias("basin_id"), F.lit(1).alias("reg_id"), F.size("ids").alias("num_subcatchments"), F.col("ids").alias("subc_ids")).alias("b"))
    return L.parse_job_results(one.select(F.to_json(F.struct(F.array("b").alias("subcatchment_ids_per_basin"))).alias("json"))).select("basin_id", F.col("subc_id").cast("int").alias("subc_id"))
