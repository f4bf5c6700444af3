"""River-network views over the star-schema test tables, for Spark and, as SQL text, for DuckDB.

``div`` below stands for integer division: ``div`` in Spark, ``//`` in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thalweg.plans.scratch import tasks_for

# a mean of prices in cents can end in half a cent, which engines round either way; the small shift keeps means off such ties
VIEWS: dict[str, str] = {
    "net": "SELECT c_custkey AS subc_id, CASE WHEN c_custkey = 0 THEN -1 ELSE c_custkey div 2 END AS target, abs(c_acctbal) + 1 AS length, c_mktsegment = 'MACHINERY' AS barrier FROM customer",
    "net_forest": "SELECT c_custkey AS subc_id, CASE WHEN c_custkey < 8 THEN -1 ELSE c_custkey div 2 END AS target, abs(c_acctbal) + 1 AS length, c_mktsegment = 'MACHINERY' AS barrier, c_nationkey AS nation FROM customer",
    "net_deep": "SELECT p_partkey AS subc_id, CASE WHEN p_partkey % 200 = 0 THEN -1 ELSE p_partkey - 1 END AS target, p_retailprice AS length FROM part",
    "occ": "SELECT o_orderkey AS site_id, o_orderpriority AS species, o_custkey AS subc_id, o_orderdate FROM orders",
    "dams": "SELECT s_suppkey AS site_id, s_suppkey * 15 + s_suppkey % 7 AS subc_id, CASE WHEN s_suppkey % 3 = 0 THEN 'existing' ELSE 'planned' END AS status, abs(s_acctbal) AS power_mw FROM supplier",
    "attrs": "SELECT o_custkey AS subc_id, o_custkey % 4 AS tile, round(avg(o_totalprice) + 0.0013, 2) AS price_mean, round(min(o_totalprice), 2) AS price_min, round(max(o_totalprice), 2) AS price_max, count(*) AS n_orders FROM orders GROUP BY o_custkey",
    "cells": "SELECT l_orderkey AS cell_row, l_linenumber AS cell_col, max(l_suppkey) AS zone, CASE WHEN min(l_discount) = 0 THEN NULL ELSE sum(l_quantity) END AS value FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "pts": "SELECT event_id AS id, round(CAST((user_id % 360) - 180 + (event_id % 1000) / 1000.0 AS DOUBLE), 4) AS lon, round(CAST((user_id % 170) - 85 + (event_id % 1250) / 1250.0 AS DOUBLE), 4) AS lat, event_type AS kind, value AS v FROM events",
    "sites": "SELECT s_suppkey AS id, s_nationkey AS basin, CAST(s_suppkey * 7 % 360 - 180 + s_nationkey / 25.0 AS DOUBLE) AS lon, CAST(s_suppkey * 11 % 170 - 85 + s_nationkey / 50.0 AS DOUBLE) AS lat FROM supplier",
    "catalog": "SELECT 'env/' || lower(replace(p_brand, '#', '')) || '/' || lower(replace(p_brand, '#', '')) || '_h' || lpad(CAST(p_size % 36 AS VARCHAR), 2, '0') || 'v' || lpad(CAST(p_size % 18 AS VARCHAR), 2, '0') || '.zip' AS file_path, 'id' || CAST(p_partkey AS VARCHAR) AS file_id, p_partkey * 1000 + p_size AS file_size FROM part",
    "preds": "SELECT l.doc_id, l.quality AS observed, d.n_chars / (m.top + 0.0) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id CROSS JOIN (SELECT max(n_chars) AS top FROM documents) m",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables below ``sf_dir``; only the tables that it names are opened."""
    text = VIEWS[name].replace("VARCHAR", "STRING")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t} " in f"{text} "}
    if name == "cells":  # nearly as many cells as rows: dealt into tasks whose number grows with the table
        frames["lineitem"] = frames["lineitem"].repartition(tasks_for(frames["lineitem"]), "l_orderkey", "l_linenumber")
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **frames)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL: ``body`` after the views that it names."""
    heads = [f"{n} AS ({VIEWS[n].replace(' div ', ' // ')})" for n in names]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = True, ", " + body[15:] if heads else body[15:]
    elif body.upper().startswith("WITH "):
        body = ", " + body[5:] if heads else body[5:]
    elif not heads:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(heads)} {body}" if heads or recursive else f"WITH {body}"
