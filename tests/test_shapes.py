"""Rings from sides, unions of tiles, scanline filling, buffers of cells and parts of lines against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from thalweg.operators import geometry as GEO
from thalweg.operators import grid as G
from thalweg.operators import shapes as S

RING = "array<struct<x: double, y: double>>"
GRID = G.Grid(0.0, 20.0, 0.5, 0.25)


def area(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def points(ring):
    return [(p["x"], p["y"]) for p in ring]


def outline(squares):
    """Rings of a set of unit squares (column, row), turning right where rings touch; the shape on the right."""
    sides = {}
    for x, y in squares:
        for a, b in (((x, y), (x, y + 1)), ((x, y + 1), (x + 1, y + 1)), ((x + 1, y + 1), (x + 1, y)), ((x + 1, y), (x, y))):
            if (b, a) in sides:
                del sides[b, a]
            else:
                sides[a, b] = True
    after, rings = {}, []
    for a, b in sides:
        after.setdefault(a, []).append(b)
    while after:
        at, came, ring = min(after), None, []
        while at in after:
            ends = after[at]
            to = ends[0] if came is None else min(ends, key=lambda e: math.atan2((at[0] - came[0]) * (e[1] - at[1]) - (at[1] - came[1]) * (e[0] - at[0]), (at[0] - came[0]) * (e[0] - at[0]) + (at[1] - came[1]) * (e[1] - at[1])))
            ends.remove(to)
            if not ends:
                del after[at]
            ring.append(at)
            came, at = at, to
            if at == ring[0]:
                break
        turns = [p for k, p in enumerate(ring) if (p[0] - ring[k - 1][0]) * (ring[(k + 1) % len(ring)][1] - p[1]) != (p[1] - ring[k - 1][1]) * (ring[(k + 1) % len(ring)][0] - p[0])]
        k = turns.index(min(turns))
        rings.append(tuple(turns[k:] + turns[:k]))
    return rings


def test_union_of_tiles_with_t_junctions_holes_and_corners(spark):
    rng = random.Random(5)
    owner = {(x, y): rng.randrange(3) for x in range(14) for y in range(9)}
    rows = []
    for (x, y), z in owner.items():
        kind = rng.randrange(4)  # squares whole, in halves of either kind, or twice
        boxes = {0: [(x, y, x + 1, y + 1)], 1: [(x, y, x + 0.5, y + 1), (x + 0.5, y, x + 1, y + 1)], 2: [(x, y, x + 1, y + 0.25), (x, y + 0.25, x + 1, y + 1)], 3: [(x, y, x + 1, y + 1)] * 2}[kind]
        for x0, y0, x1, y1 in boxes:
            ring = [(float(a), float(b)) for a, b in ((x0, y0), (x0, y1), (x1, y1), (x1, y0))]
            rows.append((z, [*reversed(ring)] if rng.random() < 0.5 else ring, False))
    rows += [(None, rows[0][1], False), (1, None, False), (1, [], False), (1, [(50.0, 1.0), (51.0, 2.0)], False)]
    got = S.dissolve_polygons(spark.createDataFrame(rows, f"id int, ring {RING}, hole boolean").repartition(3), tile=3.0).collect()
    want = Counter((z, tuple(r)) for z in range(3) for r in outline({c for c, o in owner.items() if o == z}))
    assert Counter((r["id"], tuple(points(r["ring"]))) for r in got) == want
    for r in got:
        assert r["hole"] == (area(points(r["ring"])) > 0)


def test_a_bay_that_opens_at_a_corner_only_belongs_to_one_ring(spark):
    # all around (1, 1) but its lower left: the ring comes twice to the point (1, 1), no side runs in two rings
    squares = {(x, y) for x in range(3) for y in range(3)} - {(1, 1), (0, 0)}
    rows = [(0, [(float(a), float(b)) for a, b in ((x, y), (x, y + 1), (x + 1, y + 1), (x + 1, y))]) for x, y in squares]
    for tile in (1.0, 8.0):
        rings = [points(r["ring"]) for r in S.dissolve_polygons(spark.createDataFrame(rows, f"id int, ring {RING}"), tile=tile).collect()]
        assert len(rings) == 1 and rings[0].count((1.0, 1.0)) == 2
        assert -sum(map(area, rings)) == len(squares)


def test_union_of_rings_with_holes_and_slanting_borders(spark):
    outer, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    # two halves of a plug along a diagonal with a point on it that one half lacks
    a, b = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0)], [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (1.0, 3.0)]
    rows = [(1, outer, False), (1, hole, True), (2, outer, False), (2, hole, True), (2, a, False), (2, b, False), (3, a, False)]
    got = S.dissolve_polygons(spark.createDataFrame(rows, f"id int, ring {RING}, hole boolean")).collect()
    assert sorted((r["id"], r["hole"], abs(area(points(r["ring"]))), len(r["ring"])) for r in got) == [(1, False, 16.0, 4), (1, True, 4.0, 4), (2, False, 16.0, 4), (3, False, 2.0, 3)]
    assert S.dissolve_polygons(spark.createDataFrame([], f"id int, ring {RING}")).collect() == []


def test_a_ring_over_many_tiles(spark):
    n = 400
    ring = [(math.cos(2 * math.pi * k / n) * 30, math.sin(2 * math.pi * k / n) * 30) for k in range(n)]
    sides = [(1, *ring[k], *ring[k - 1]) for k in range(n)]  # clockwise
    got = S.chain_rings(spark.createDataFrame(sides, "zone int, x1 double, y1 double, x2 double, y2 double").repartition(4), 1.0).collect()
    assert len(got) == 1 and points(got[0]["ring"])[0] == min(ring) and set(points(got[0]["ring"])) == set(ring) and area(points(got[0]["ring"])) < 0


def inside(x, y, rings):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                n += 1
    return n % 2 == 1


@pytest.fixture(scope="module")
def star():
    rng = random.Random(8)
    outer = [(10 + math.cos(2 * math.pi * k / 60) * (r := rng.uniform(3, 9)), 10 + math.sin(2 * math.pi * k / 60) * r) for k in range(60)]
    return [outer, [(9.0, 9.0), (11.0, 9.5), (10.0, 11.0)]]  # concave, with a hole


def test_filling_and_points_against_rays(spark, star):
    box = [(1.0, 1.0), (6.5, 1.0), (6.5, 3.0), (1.0, 3.0)]
    polygons = spark.createDataFrame([(1, star[0]), (1, star[1]), (2, box), (3, None), (4, []), (None, box)], f"poly_id int, ring {RING}")
    want = {(p, r, c) for r in range(80) for c in range(45) for p, rings in ((1, star), (2, [box])) if inside((c + 0.5) * 0.5, 20 - (r + 0.5) * 0.25, rings)}
    assert {tuple(r) for r in S.fill(polygons, GRID).collect()} == want
    cells = spark.createDataFrame([(r, c) for r in range(0, 80, 3) for c in range(45)], "cell_row int, cell_col int")
    assert {tuple(r) for r in GEO.rasterise(polygons, cells, GRID).collect()} == {w for w in want if w[1] % 3 == 0}
    rng = random.Random(9)
    at = [(k, rng.uniform(0, 20), rng.uniform(0, 20)) for k in range(400)] + [(900, None, 1.0), (901, 1.0, None)]
    got = {tuple(r) for r in GEO.points_in_polygons(spark.createDataFrame(at, "id int, lon double, lat double"), polygons, 5.0).collect()}
    assert got == {(k, p) for k, x, y in at[:400] for p, rings in ((1, star), (2, [box])) if inside(x, y, rings)}


def test_filling_with_all_cells_that_are_touched(spark, star):
    polygons = spark.createDataFrame([(1, star[0]), (1, star[1])], f"poly_id int, ring {RING}")
    got = {tuple(r)[1:] for r in S.fill(polygons, GRID, touched=True).collect()}
    centres = {tuple(r)[1:] for r in S.fill(polygons, GRID).collect()}
    fine = set()
    for ring in star:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            for k in range(2001):
                t = k / 2000
                fine.add((math.floor((20 - (y1 + t * (y2 - y1))) / 0.25), math.floor((x1 + t * (x2 - x1)) / 0.5)))
    assert centres <= got and fine <= got and len(got - fine - centres) <= 3  # cells that a side only grazes between two steps


def test_a_piece_with_many_parts(spark):
    teeth = [(0.0, -1.0)]
    for k in range(200):
        teeth += [(k / 10 + 0.02, 1.0), (k / 10 + 0.06, 1.0), (k / 10 + 0.08, -0.5)]
    teeth += [(20.5, -1.0)]
    lines = spark.createDataFrame([(1, [(-1.0, 0.0), (21.0, 0.0)]), (2, [(-1.0, 0.5), (3.0, 0.5)])], f"subc_id int, geom {RING}")
    got = GEO.lines_in_polygons(lines, spark.createDataFrame([(7, teeth)], f"poly_id int, ring {RING}")).collect()
    first = sorted(r["part"] for r in got if r["id"] == 1)
    assert first == list(range(len(first))) and len(first) >= 200
    by_part = sorted((r["part"], r["x1"]) for r in got if r["id"] == 1)
    assert [x for _, x in by_part] == sorted(x for _, x in by_part)
    assert len({(r["id"], r["poly_id"], r["seq"], r["part"]) for r in got}) == len(got)


@pytest.mark.parametrize("radius", [0.0, 1.0, 2.3, 5.0])
def test_buffers_against_all_pairs(spark, radius):
    rng = random.Random(3)
    lakes = [(1, rng.randrange(12), rng.randrange(12)) for _ in range(40)] + [(2, 30, 30)] + [(2, 31, c) for c in range(20, 40)] + [(None, 1, 1)]
    lakes += lakes[:3]
    got = {tuple(r) for r in S.buffer_cells(spark.createDataFrame(lakes, "lake_id int, cell_row int, cell_col int").repartition(3), radius).collect()}
    want = {}
    for k, r, c in lakes:
        if k is not None:
            n = int(radius)
            for i in range(-n, n + 1):
                for j in range(-n, n + 1):
                    if i * i + j * j <= radius * radius:
                        want[k, r + i, c + j] = min(want.get((k, r + i, c + j), 10**9), i * i + j * j)
    assert got == {(*k, d) for k, d in want.items()}


def test_buffers_of_their_own_width(spark):
    lakes = spark.createDataFrame([(1, 0, 0, 1.0), (2, 50, 50, 3.0), (3, 9, 9, None)], "lake_id int, cell_row int, cell_col int, wide double")
    n = {r["lake_id"]: r["count"] for r in S.buffer_cells(lakes, F.col("wide")).groupBy("lake_id").count().collect()}
    assert n == {1: 5, 2: 29}
    widths = spark.createDataFrame([(0.5,), (1.0,), (20.0,), (100.0,), (101.0,)], "a double").select(S.buffer_width(F.col("a")).alias("w"))
    assert [r["w"] for r in widths.collect()] == [0.0009, 0.0009, 0.0018, 0.0027, 0.0036]


def test_parts_of_lines(spark):
    line = [(0.0, 0.0), (3.0, 0.0), (3.0, 4.0), (3.0, 4.0), (6.0, 8.0)]  # 3 + 4 + 0 + 5 long
    lines = spark.createDataFrame([(1, line), (2, [(0.0, 0.0)]), (3, [(1.0, 1.0), (1.0, 1.0)]), (4, None)], f"subc_id int, geom {RING}")
    parts = [(1, 0.0, 1.0), (1, 0.25, 0.5), (1, 0.125, 0.125), (1, 7 / 12, 1.0), (1, 0.9, 0.2), (1, 0.0, 1.5), (2, 0.0, 1.0), (3, 0.0, 1.0), (4, 0.0, 1.0), (9, 0.0, 1.0)]
    got = {(r["fraction_start"], r["fraction_end"]): points(r["geom"]) for r in S.cut_lines(lines, spark.createDataFrame(parts, "id int, fraction_start double, fraction_end double"), planar=True).collect()}
    assert set(got) == {(0.0, 1.0), (0.25, 0.5), (0.125, 0.125), (7 / 12, 1.0)}
    assert got[0.25, 0.5] == [(3.0, 0.0), (3.0, 3.0)] and got[0.125, 0.125] == [(1.5, 0.0), (1.5, 0.0)]
    assert got[0.0, 1.0][0] == (0.0, 0.0) and got[0.0, 1.0][-1] == pytest.approx((6.0, 8.0)) and got[7 / 12, 1.0][0] == pytest.approx((3.0, 4.0))
    long = lambda p: sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False))
    for (a, b), p in got.items():
        assert long(p) == pytest.approx((b - a) * 12)


def clipped(line, box):
    """Piece by piece."""
    xmin, ymin, xmax, ymax = box
    parts = []
    for k, ((x1, y1), (x2, y2)) in enumerate(zip(line, line[1:], strict=False)):
        lo, hi, dx, dy, out = 0.0, 1.0, x2 - x1, y2 - y1, False
        for p, q in ((-dx, x1 - xmin), (dx, xmax - x1), (-dy, y1 - ymin), (dy, ymax - y1)):
            if p == 0:
                out |= q < 0
            elif p < 0:
                lo = max(lo, q / p)
            else:
                hi = min(hi, q / p)
        if out or lo > hi:
            continue
        a = (x1 + lo * dx, y1 + lo * dy)
        b = (x2, y2) if hi == 1 else (x1 + hi * dx, y1 + hi * dy)
        if parts and parts[-1][0] == k - 1 and parts[-1][1][-1] == a:
            parts[-1] = (k, [*parts[-1][1], b])
        else:
            parts.append((k, [a, b]))
    return [p for _, p in parts]


def test_lines_in_a_box_against_piece_by_piece(spark):
    rng = random.Random(12)
    lines = [(k, [(rng.choice([rng.uniform(-2, 12), float(rng.randint(-2, 12))]), rng.choice([rng.uniform(-2, 12), float(rng.randint(-2, 12))])) for _ in range(rng.randint(1, 12))]) for k in range(150)]
    lines += [(900, []), (901, [(5.0, 5.0)]), (902, [(0.0, 0.0), (10.0, 10.0), (0.0, 0.0)])]
    box = (0.0, 1.0, 10.0, 9.0)
    got = GEO.clip_vectors(spark.createDataFrame(lines, f"subc_id int, geom {RING}").repartition(3), box).collect()
    rounded = lambda p: tuple((round(x, 9), round(y, 9)) for x, y in p)
    assert Counter((r["subc_id"], rounded(points(r["geom"]))) for r in got) == Counter((k, rounded(p)) for k, line in lines for p in clipped(line, box))


def test_lakes_of_points_and_boxes(spark, star):
    square = [(20.0, 20.0), (30.0, 20.0), (30.0, 30.0), (20.0, 30.0)]
    lakes = spark.createDataFrame([(1, star[0]), (1, star[1]), (2, square), (3, None), (None, square)], f"lake_id int, ring {RING}")
    at = lambda *rows: spark.createDataFrame(rows, "lon double, lat double")
    ids = lambda df: sorted(r["lake_id"] for r in df.collect())
    assert ids(S.lake_ids(lakes, at((25.0, 25.0), (25.0, 25.0), (10.0, 10.0), (None, 1.0)))) == [2]  # the other lies in the hole
    assert ids(S.lake_ids(lakes, at((25.0, 25.0)), (24.0, 24.0, 26.0, 26.0))) == [2]  # inside altogether
    assert ids(S.lake_ids(lakes, at((25.0, 25.0)), (9.9, 9.9, 10.1, 10.1))) == []  # inside the hole
    assert ids(S.lake_ids(lakes, at((0.0, 0.0), (40.0, 40.0)), True)) == [1, 2] and ids(S.lake_ids(lakes, at((30.0, 30.0)), True)) == [2]
    assert ids(S.lake_ids(lakes, at((30.5, 25.0), (40.0, 26.0)), True)) == [] and ids(S.lake_ids(lakes, at((29.5, 25.0), (40.0, 26.0)), True)) == [2]
    assert ids(S.lake_ids(lakes, at((1.0, 1.0)).limit(0), True)) == []
