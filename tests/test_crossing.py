"""Joins whose result is far larger than their sides: whole, dealt by their rows, and in an order that files hold in few bytes."""

import os

from thalweg.operators import geometry as GEO
from thalweg.operators import grid as G
from thalweg.operators.crossing import crossed
from thalweg.operators.lookup import get_ids


def _bytes(folder):
    return sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet"))


def test_parts_meet_once(spark):
    # keys 0 to 6 on both sides, 7 and 8 on one side only, a null on both
    many = spark.range(150).selectExpr("IF(id = 149, NULL, id % 8) AS k", "id AS site", "id % 3 AS more")
    few = spark.range(90).selectExpr("IF(id % 10 = 9, NULL, IF(id % 10 = 7, 8, id % 10)) AS k", "id + 1000 AS v")
    want = sorted(map(tuple, many.join(few, "k").collect()))
    assert len(want) > 1000
    for part, run in ((4096, 128), (4, 3), (5, 8), (1, 1)):
        got = crossed(many, few, "k", "v", part, run)
        assert got.columns == ["k", "site", "more", "v"]
        assert sorted(map(tuple, got.collect())) == want
    assert crossed(many, few, "k", "v", 4, 3).rdd.getNumPartitions() == -(-len(want) // 16)
    assert crossed(many.where("k > 8"), few, "k", "v").collect() == []


def test_upstream_ids_are_few_bytes_a_row(spark, tmp_path):
    # 40,000 segments with scattered ids flow into one, where 60 points lie: in the order of the points no page of a file holds an id twice
    ids = spark.range(40_000).selectExpr("1 + id * 7919 % 1000003 AS subc_id").where("subc_id <> 5")
    net = ids.selectExpr("subc_id", "5L AS target", "1L AS basin_id", "1L AS reg_id", "2 AS strahler").unionByName(spark.sql("SELECT 5L AS subc_id, -1L AS target, 1L AS basin_id, 1L AS reg_id, 1 AS strahler"))
    points = spark.range(60).selectExpr("id * 31 AS site_id", "0.5 AS longitude", "0.5 AS latitude")
    cells = spark.sql("SELECT 89L AS cell_row, 180L AS cell_col, 5L AS value")
    up = get_ids(net, "upstream", points, min_strahler=2, cells=cells, grid=G.Grid(dx=1.0, dy=1.0))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        up.write.parquet(str(tmp_path / "up"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = spark.read.parquet(str(tmp_path / "up"))
    n = ids.count()
    assert rows.count() == rows.distinct().count() == 60 * n
    assert rows.select("upstream_id").distinct().count() == n
    assert _bytes(tmp_path / "up") < 0.6 * 60 * n


def test_equal_shapes_and_places_are_dealt_by_the_rows_they_make(spark):
    square = "array(struct(0D AS x, 0D AS y), struct(0D AS x, 2D AS y), struct(2D AS x, 2D AS y), struct(2D AS x, 0D AS y)) AS ring"
    polygons = spark.range(300).selectExpr("id AS poly_id", square)
    points = spark.range(400).selectExpr("id", "1.0D AS lon", "IF(id % 4 = 0, 9.0D, 1.0D) AS lat")
    held = GEO.points_in_polygons(points, polygons, 4.0)
    assert held.rdd.getNumPartitions() == 4  # adaptive execution made one task of so little input
    assert sorted(map(tuple, held.collect())) == [(i, p) for i in range(400) if i % 4 for p in range(300)]
