"""The number of tasks grows with the input, and what is shuffled is no more than the input and its rims."""

import random

from thalweg.operators import geometry as GEO
from thalweg.operators import grid as G
from thalweg.operators import habitat as H
from thalweg.operators import network as N
from thalweg.operators import shapes as S
from thalweg.plans.network_queries import QUERIES
from thalweg.plans.scratch import tasks_for


def test_tasks_grow_with_the_files(spark, tmp_path):
    spark.range(20_000).repartition(2).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert tasks_for(t) == 4  # those of a shuffle at least
    assert tasks_for(t, 0.01) > 2 * tasks_for(t, 0.02) - 2 > 4
    assert tasks_for(spark.range(5)) == 4


def test_rasters_are_dealt_into_those_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "tasks_for", lambda df: 23)
    cells = spark.range(400).selectExpr("id div 20 AS cell_row", "id % 20 AS cell_col", "id AS value")
    for df in (G.mosaic([cells, cells]), G.focal(cells), G.edge_cells(cells)):
        assert df.rdd.getNumPartitions() == 23


def test_windows_over_the_borders_of_blocks(spark):
    draw = random.Random(5)
    at = {(r, c): draw.randint(0, 99) for r in range(-70, 135) for c in range(58, 70) if draw.random() < 0.7}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in at.items()], "cell_row long, cell_col int, value long")
    around = {k: [at[k[0] + i, k[1] + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (k[0] + i, k[1] + j) in at] for k in at}
    got = {(x["cell_row"], x["cell_col"]): (x["value"], x["focal_max"], round(x["focal_mean"], 9)) for x in G.focal(cells).collect()}
    assert got == {k: (at[k], max(v), round(sum(v) / len(v), 9)) for k, v in around.items()}
    assert {tuple(x) for x in G.edge_cells(cells).collect()} == {k for k, v in around.items() if len(v) < 9}
    beside = {(r + i, c + j) for r, c in at for i in (-1, 0, 1) for j in (-1, 0, 1)} - set(at)
    assert sorted(map(tuple, G.edge_cells(cells, border=False).collect())) == sorted(beside)


def test_blocks_of_points_meet_once_in_as_many_tasks(spark):
    points = spark.range(60).selectExpr("id", "id % 2 AS g", "id * 1.5 AS lon", "id - 30.0 AS lat")
    for by, block, meetings in ((None, 10, 21), ("g", 10, 12)):
        d = GEO.point_distances(points, by, block=block)
        assert d.rdd.getNumPartitions() == meetings
        rows = d.collect()
        assert len({(r["from"], r["to"]) for r in rows}) == len(rows) == (60 * 59 // 2 if by is None else 30 * 29)
        assert all(r["from"] < r["to"] for r in rows)


def test_patches_meet_once_where_all_their_members_come_together(spark):
    draw = random.Random(3)
    target = {k: k // 2 if k > 1 else -1 for k in range(1, 128)}
    length = {k: float(draw.randint(1, 9)) for k in target}
    net = N.RiverNetwork(spark.createDataFrame([(k, t, length[k]) for k, t in target.items()], "subc_id long, target long, length double"))
    patch = {k: k // 8 if k % 3 else draw.randint(50, 53) for k in target if k % 4 < 3}  # near ones and scattered ones

    def way(k):
        out = {}
        d = 0.0
        while k > 0:
            out[k] = d
            d, k = d + length[k], target[k]
        return out

    ways, want = {k: way(k) for k in patch}, {}
    for a in patch:
        for b in patch:
            if patch[a] < patch[b]:
                d = min(ways[a][m] + ways[b][m] for m in ways[a].keys() & ways[b].keys())
                want[patch[a], patch[b]] = min(d, want.get((patch[a], patch[b]), d))
    patches = spark.createDataFrame(list(patch.items()), "id long, patch long")
    got = H.patch_distances(net, patches).collect()
    assert len(got) == len(want) and {(r["patch_a"], r["patch_b"]): r["distance"] for r in got} == want
    members = N.with_via(N.walk_down(net, patches.select("id"))).join(patches.withColumnRenamed("id", "base"), "base")
    assert N.meetings(members, block=4, nearest="patch").count() < N.meetings(members.drop("patch"), block=4).count() == len(patch) * (len(patch) - 1) // 2


def test_pairs_of_points_on_a_network_are_not_shuffled(spark):
    net = N.RiverNetwork(spark.range(1, 64).selectExpr("id AS subc_id", "id div 2 AS target", "1.0 AS length"))
    at = spark.range(32, 64).selectExpr("id", "id AS subc_id", "0.5 AS fraction")
    plan = GEO.network_distances(net, at)._jdf.queryExecution().executedPlan().toString()
    first = plan.split("Union")[1].split("SortMergeJoin", 1)[0]  # from the result down to the join that makes the pairs
    assert "Exchange" not in first and "meet" not in first.replace("meet#", "")
    assert "i#" in plan.split("SortMergeJoin", 2)[1].split("\n")[0]


def test_points_meet_pieces_in_tasks_by_the_files(spark, monkeypatch):
    monkeypatch.setattr(GEO, "tasks_for", lambda df, mb: 7)
    points = spark.createDataFrame([(1, 0.1, 0.0), (1, 3.0, 0.2), (2, 3.0, 0.1), (3, 9.0, 0.0)], "id long, lon double, lat double")
    lines = spark.createDataFrame([(5, [(0.0, 0.0), (0.0, 1.0)]), (6, [(2.9, 0.0), (2.9, 1.0)])], "subc_id long, geom array<struct<x: double, y: double>>")
    near = GEO.nearest_segment(points, lines, 50_000.0)
    assert near.rdd.getNumPartitions() == 7
    rows = near.collect()
    assert len(rows) == 2 and {r["id"] for r in rows} == {1, 2}


def test_outlines_over_the_borders_of_blocks_and_rings_of_one_tile(spark, monkeypatch):
    draw = random.Random(7)
    cells = {(r, c, draw.randrange(2)) for r in range(-6, 9) for c in range(-5, 9) if draw.random() < 0.8}
    rows = spark.createDataFrame([*cells] * 2, "cell_row int, cell_col long, value int")
    grid, want = G.Grid(0.0, 0.0, 1.0, 1.0), set()
    for r, c, z in cells:
        for dr, dc, a, b in ((-1, 0, (c, -r), (c + 1, -r)), (0, 1, (c + 1, -r), (c + 1, -r - 1)), (1, 0, (c + 1, -r - 1), (c, -r - 1)), (0, -1, (c, -r - 1), (c, -r))):
            if (r + dr, c + dc, z) not in cells:
                want.add((z, *a, *b))
    sides = GEO.cell_outlines(rows, grid, block=4)
    assert sides._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the cells', sides are not shuffled
    assert sorted(map(tuple, sides.collect())) == sorted(want)
    kept = []
    monkeypatch.setattr(S, "materialize", lambda df, name, write=S.materialize: kept.append(name) or write(df, name))
    rings = {tile: sorted((z, tuple(map(tuple, ring))) for z, ring in S.chain_rings(sides, tile).collect()) for tile in (2.0, 64.0)}
    assert rings[2.0] == rings[64.0]
    assert sorted((z, *ring[k - 1], *ring[k]) for z, ring in rings[2.0] for k in range(len(ring))) == sorted(want)
    assert kept == ["chains", "chains"]  # sides find what follows them in their tile, they are not written and joined for it


def test_buffers_over_the_borders_of_blocks_shuffle_the_lakes_cells_only(spark, monkeypatch):
    draw = random.Random(11)
    lakes = {(k, draw.randrange(-9, 12), draw.randrange(-9, 12)) for k in (1, 2) for _ in range(60)}
    rows = spark.createDataFrame([*lakes] * 2, "lake_id int, cell_row int, cell_col int")
    monkeypatch.setattr(S, "tasks_for", lambda df, mb: 7)
    got = S.buffer_cells(rows, 1.5 + G.F.col("lake_id"), block=4)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and got.rdd.getNumPartitions() == 7
    want = {}
    for k, r, c in lakes:
        for i in range(-3, 4):
            for j in range(-3, 4):
                if i * i + j * j <= (1.5 + k) ** 2:
                    want[k, r + i, c + j] = min(want.get((k, r + i, c + j), 99), i * i + j * j)
    assert sorted(map(tuple, got.collect())) == sorted((*at, d) for at, d in want.items())


def test_orders_write_only_what_the_next_order_needs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("thalweg.plans.fixtures.VIEWS", {"net": "SELECT c_custkey AS subc_id, CASE WHEN c_custkey = 1 THEN -1 ELSE c_custkey div 2 END AS target, 1.0D AS length FROM customer"})
    spark.range(1, 128).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    written = []

    def materialize(df, name, write=N.materialize):
        out = write(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(N, "materialize", materialize)
    leaves = {k: 2 ** (7 - k.bit_length()) for k in range(1, 128)}
    assert {r["subc_id"]: r["shreve"] for r in QUERIES["g_shreve"](spark, str(tmp_path)).collect()} == leaves
    assert "joints" not in {name for name, _ in written}  # Shreve's numbers are one accumulation, no rounds for Strahler's orders
    written.clear()
    assert {r["subc_id"]: r["strahler"] for r in QUERIES["g_strahler"](spark, str(tmp_path)).collect()} == {k: 8 - k.bit_length() for k in leaves}
    assert [n for name, n in written if name == "orders"] == [63, 31, 15, 7, 3, 1]  # the segments of the order, not all of them each time
