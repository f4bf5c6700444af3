"""Points on a side, cells that a side only touches in a corner, places beyond the 180th meridian."""

from decimal import Decimal

from thalweg.operators import cleaning as CL
from thalweg.operators import geometry as GEO
from thalweg.operators import grid as G
from thalweg.operators import shapes as S

_RING = "poly_id long, ring array<struct<x: double, y: double>>"


def test_points_on_a_side_and_equal_shapes(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    polygons = spark.createDataFrame([(7, square), (3, square), (9, [(10.0, 0.0), (14.0, 0.0), (12.0, 4.0)])], _RING)
    points = spark.createDataFrame([(1, 0.0, 2.0), (2, 2.0, 0.0), (3, 2.0, 2.0), (4, 2.0, 2.0), (5, 4.0, 2.0), (6, 12.0, 1.0)], "id long, lon double, lat double")
    found = lambda border: sorted(map(tuple, GEO.points_in_polygons(points, polygons, 5.0, border=border).collect()))
    inner = [(3, 3), (3, 7), (4, 3), (4, 7), (6, 9)]
    assert found(False) == inner
    assert found(True) == sorted([*inner, *[(i, z) for i in (1, 2, 5) for z in (3, 7)]])


def test_cells_touched_in_a_corner_only(spark):
    # the side from (0, 0) to (2, 2) passes the corner (1, 1)
    polygon = spark.createDataFrame([(1, [(Decimal(0), Decimal(0)), (Decimal(2), Decimal(2)), (Decimal(2), Decimal(0))])], "poly_id long, ring array<struct<x: decimal(12,4), y: decimal(12,4)>>")
    cells = {(r["cell_row"], r["cell_col"]) for r in S.fill(polygon, G.Grid(0.0, 4.0, 1.0, 1.0), touched="through").collect()}
    assert {(2, 1), (3, 0), (3, 1)} <= cells
    assert (2, 0) not in cells and (1, 2) not in cells


def test_places_beyond_the_meridian_and_the_pole(spark):
    places = spark.createDataFrame([(-179.9, 10.0), (30.0, 89.9)], "lon double, lat double")
    points = spark.createDataFrame([(1, 179.9, 10.0), (2, 178.0, 10.0), (3, -150.0, 89.9), (4, 0.0, 80.0)], "id long, lon double, lat double")
    assert sorted(r["id"] for r in CL.away_from(points, places, 50_000.0).collect()) == [2, 4]
