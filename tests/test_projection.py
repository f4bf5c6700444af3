"""Projected coordinates against published points and round trips, areas and centroids, records near places, ways without pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from thalweg.operators import cleaning as CL
from thalweg.operators import habitat as H
from thalweg.operators import network as N
from thalweg.operators import projection as P

RING = "array<struct<x: double, y: double>>"


def test_published_points(spark):
    # towers whose coordinates are widely given, to the metre; the third lies on its zone's middle and the equator
    rows = [(1, -79.387139, 43.642567, 17, 630084.0, 4833438.0), (2, 2.2945, 48.8582, 31, 448251.8, 5411932.7), (3, 9.0, 0.0, 32, 500000.0, 0.0)]
    t = spark.createDataFrame(rows, "id int, lon double, lat double, zone int, east double, north double")
    e, n = P.to_utm(F.col("lon"), F.col("lat"), P.zone_of(F.col("lon")))
    for r in t.select("*", e.alias("e"), n.alias("n"), P.zone_of(F.col("lon")).alias("z")).collect():
        assert r["z"] == r["zone"] and abs(r["e"] - r["east"]) < 1 and abs(r["n"] - r["north"]) < 1


def test_round_trips_within_a_millimetre(spark):
    rng = random.Random(2)
    rows = [(k, rng.uniform(-180, 179.99), rng.uniform(-80, 84)) for k in range(400)] + [(900, -180.0, 10.0), (901, 179.999, -10.0), (902, None, 5.0)]
    t = spark.createDataFrame(rows, "id int, lon double, lat double").withColumn("zone", P.zone_of(F.col("lon"))).withColumn("south", F.col("lat") < 0)
    e, n = P.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south"))
    t = t.withColumn("e", e).withColumn("n", n)
    lon, lat = P.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    for r in t.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        if r["lon"] is None:
            assert r["e"] is None and r["lon2"] is None
            continue
        assert math.hypot((r["lon"] - r["lon2"]) * 111_320 * math.cos(math.radians(r["lat"])), (r["lat"] - r["lat2"]) * 110_574) < 1e-3
        assert 100_000 < r["e"] < 900_000 and 0 <= r["n"] <= 10_000_000


def test_areas_are_true(spark):
    # the ellipsoid as a whole, and a box against the integral of its parallels' circles
    whole = [(-180.0, -90.0), (-180.0, 90.0), (180.0, 90.0), (180.0, -90.0)]
    box = [(10.0, 40.0), (10.0, 41.0), (12.0, 41.0), (12.0, 40.0)]
    t = spark.createDataFrame([(1, whole), (2, box), (3, [(1.0, 1.0), (2.0, 2.0)]), (4, None)], f"id int, ring {RING}")
    got = {r["id"]: r for r in P.ring_measures(t).collect()}
    assert got[1]["area"] == pytest.approx(510_065_622, rel=1e-7)
    e2, n, area = 2 * P.FLAT - P.FLAT**2, 2000, 0.0
    for k in range(n):
        s = math.sin(math.radians(40 + (k + 0.5) / n))
        area += P.A**2 * (1 - e2) * math.cos(math.asin(s)) / (1 - e2 * s * s) ** 2 * math.radians(2) * math.radians(1 / n) / 1e6
    assert got[2]["area"] == pytest.approx(area, rel=1e-6) and (got[2]["x"], got[2]["y"]) == pytest.approx((11.0, 40.5))
    assert got[3]["area"] == pytest.approx(0) and got[3]["x"] is None and 4 not in got


def test_centroids_with_holes_far_from_the_origin(spark):
    outer, hole = [(1e6, 1e6), (1e6, 1e6 + 4), (1e6 + 4, 1e6 + 4), (1e6 + 4, 1e6)], [(1e6 + 2, 1e6), (1e6 + 4, 1e6), (1e6 + 4, 1e6 + 4), (1e6 + 2, 1e6 + 4)]
    r = P.ring_measures(spark.createDataFrame([(1, outer), (1, hole)], f"id int, ring {RING}"), planar=True).first()
    assert (r["area"], r["x"], r["y"]) == pytest.approx((8.0, 1e6 + 1, 1e6 + 2), abs=1e-6)
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 6.0)]), (2, [(1.0, 1.0), (1.0, 1.0)]), (3, [(0.0, 0.0)])], f"subc_id int, geom {RING}")
    got = {r["subc_id"]: (r["x"], r["y"]) for r in P.line_centroids(lines, planar=True).collect()}
    assert got == {1: (1.75, 2.25), 2: (None, None)}


def test_records_near_places(spark):
    rng = random.Random(4)
    points = [(k, rng.uniform(-3, 3), rng.uniform(60, 62), "s" if k % 5 else None) for k in range(600)] + [(900, None, 1.0, "s"), (901, 1.0, None, "s"), (902, 179.9999, 10.0, "s"), (903, 0.0, 61.0, "")]
    places = [(rng.uniform(-3, 3), rng.uniform(60, 62)) for _ in range(25)] + [(None, 1.0), (179.9998, 10.0)]
    far = lambda a, b, c, d: 2 * 6371008.8 * math.asin(math.sqrt(math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2))
    p = spark.createDataFrame(points, "id int, lon double, lat double, species string")
    q = spark.createDataFrame(places, "lon double, lat double")
    for metres in (10.0, 12_000.0):
        got = {r["id"] for r in CL.away_from(p, q, metres).collect()}
        assert got == {k for k, x, y, _ in points if x is None or y is None or not any(a is not None and far(x, y, a, b) <= metres for a, b in places)}
    some = CL.occurrence_places(p.unionByName(p), q, 12_000.0, ("lon", "lat", "species"), "species", ("id",))
    assert some.count() == some.select("id").distinct().count() and some.where("species is null or species = ''").count() == 0


def test_ways_without_pairs(spark):
    rng = random.Random(6)
    parent = {k: rng.randrange(max(0, k - 9), k) if k % 40 else -1 for k in range(200)}
    length = {k: rng.uniform(1, 9) for k in parent}
    net = N.RiverNetwork(spark.createDataFrame([(k, t, length[k]) for k, t in parent.items()], "subc_id long, target long, length double"))
    points, dams = rng.sample(range(200), 40), {5, 60, 90, 130}

    def way(k, cut):
        out = {k: 0.0}
        d = 0.0
        while parent[k] >= 0 and not (cut and (k in dams or parent[k] in dams)):
            d, k = d + length[k], parent[k]
            out[k] = d
        return out

    def pairs(cut):
        ways = [way(p, cut) for p in points]
        return [min(a[k] + b[k] for k in a.keys() & b.keys()) for i, a in enumerate(ways) for b in ways[:i] if a.keys() & b.keys()]

    ids = lambda v: spark.createDataFrame([(k,) for k in v], "id long")
    r = H.pair_connectivity(net, ids([*points, points[0]]), ids(dams)).first()
    before, after = pairs(False), pairs(True)
    assert (r["n_before"], r["n_after"]) == (len(before), len(after))
    assert r["mean_before"] == pytest.approx(sum(before) / len(before), abs=0.006) and r["mean_after"] == pytest.approx(sum(after) / len(after), abs=0.006)
    none = H.pair_connectivity(net, ids([]), ids([])).first()
    assert (none["n_before"], none["n_after"], none["mean_before"], none["lost_pct"]) == (0, 0, None, None)


def test_a_wide_star_of_points(spark):
    n = 20_000  # two hundred million pairs
    net = N.RiverNetwork(spark.range(n).selectExpr("id + 1 as subc_id", "0L as target", "2.0D as length").unionByName(spark.createDataFrame([(0, -1, 1.0)], "subc_id long, target long, length double")))
    r = H.pair_connectivity(net, spark.range(1, n + 1), spark.createDataFrame([(1,)], "id long")).first()
    assert (r["n_before"], r["n_after"], r["mean_before"], r["mean_after"]) == (n * (n - 1) // 2, (n - 1) * (n - 2) // 2, 4.0, 4.0)
