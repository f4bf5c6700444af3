"""River-network operators against brute force on small random forests."""

import math
import random

import pytest

from thalweg.operators import habitat as H
from thalweg.operators import network as N
from thalweg.operators.pfafstetter import pfafstetter


def forest(seed, n=24, roots=2):
    rng = random.Random(seed)
    return {k: (-1 if k < roots else rng.randrange(k), round(rng.uniform(1, 9), 2), rng.random() < 0.25) for k in range(n)}


@pytest.fixture(scope="module")
def rows():
    return forest(5)


@pytest.fixture(scope="module")
def net(spark, rows):
    return N.RiverNetwork(spark.createDataFrame([(k, t, w, b) for k, (t, w, b) in rows.items()], "subc_id long, target long, length double, barrier boolean"))


def path(rows, k):
    out = [k]
    while rows[out[-1]][0] >= 0:
        out.append(rows[out[-1]][0])
    return out


def distance(rows, a, b):
    pa, pb = path(rows, a), path(rows, b)
    common = [x for x in pa if x in pb]
    if not common:
        return None
    c = common[0]
    return sum(rows[x][1] for x in pa[: pa.index(c)]) + sum(rows[x][1] for x in pb[: pb.index(c)])


def test_closure_and_roots(net, rows):
    got = {(r["base"], r["stream"]): (r["hops"], round(r["dist"], 6)) for r in N.closure(net).collect()}
    want = {(b, s): (path(rows, s).index(b), round(sum(rows[x][1] for x in path(rows, s)[: path(rows, s).index(b)]), 6)) for s in rows for b in path(rows, s)}
    assert got == want
    assert {r["id"]: (r["root"], r["hops"]) for r in N.roots(net).collect()} == {k: (path(rows, k)[-1], len(path(rows, k)) - 1) for k in rows}


def test_seeded_closure_equals_full(spark, net):
    seeds = spark.createDataFrame([(0,), (3,), (3,), (99,)], "id long")
    full = {(r["base"], r["stream"]) for r in N.closure(net).where("base in (0, 3)").collect()}
    assert {(r["base"], r["stream"]) for r in N.closure(net, seeds=seeds).collect()} == full


def test_distances(net, rows):
    got = {(r["from"], r["to"]): r["distance"] for r in N.pair_distances(net, net.edges.select("id")).collect()}
    for a in rows:
        for b in rows:
            if a < b:
                d = distance(rows, a, b)
                assert ((a, b) in got) == (d is not None)
                assert d is None or math.isclose(got[a, b], d, abs_tol=1e-9)


def test_orders(net, rows):
    kids = {k: [c for c in rows if rows[c][0] == k] for k in rows}

    def strahler(k):
        s = sorted((strahler(c) for c in kids[k]), reverse=True)
        return 1 if not s else s[0] + (len(s) > 1 and s[0] == s[1])

    def shreve(k):
        return sum(map(shreve, kids[k])) or 1

    assert {r["id"]: (r["strahler"], r["shreve"]) for r in N.stream_orders(net).collect()} == {k: (strahler(k), shreve(k)) for k in rows}


def test_headwaters_use_their_own_value_without_seeds_only(spark, net, rows):
    values = spark.createDataFrame([(k, float(k)) for k in rows], "id long, v double")
    got = {r["base"]: r["v"] for r in N.upstream_variable(net, values, ["v"], "sum").collect()}
    heads = [k for k in rows if all(rows[c][0] != k for c in rows)]
    assert all(got[k] == k for k in heads)
    seeds = spark.createDataFrame([(k,) for k in heads[:2]], "id long")
    assert N.upstream_variable(net, values, ["v"], "sum", seeds).collect() == []


def test_user_statistic_and_stored_connections(spark, net, rows):
    from pyspark.sql import functions as F

    values = spark.createDataFrame([(k, float(k)) for k in rows], "id long, v double")
    stored = N.closure(net).select("base", "stream")
    got = {r["base"]: r["v"] for r in N.upstream_variable(net, values, ["v"], lambda c: F.max(c) - F.min(c), connections=stored).collect()}
    for k in rows:
        up = [s for s in rows if k in path(rows, s)]
        assert got[k] == max(up) - min(up)


def test_unknown_cycle_and_double_target(spark):
    ring = N.RiverNetwork(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "subc_id long, target long, length double"))
    with pytest.raises(ValueError, match="cycle"):
        ring.validate()
    twice = N.RiverNetwork(spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0)], "subc_id long, target long, length double"))
    with pytest.raises(ValueError, match="more than one target"):
        twice.validate()
    with pytest.raises(ValueError, match="none of the columns"):
        N.RiverNetwork(spark.createDataFrame([(1,)], "x long"))


def test_fragments_are_vertices_less_edges(net, rows):
    from pyspark.sql import functions as F

    pieces = {r["id"]: r["fragment"] for r in N.fragments(net, F.col("barrier")).collect()}
    kept = sum(1 for k, (t, _, b) in rows.items() if t >= 0 and not b)
    assert len(set(pieces.values())) == len(rows) - kept
    assert all(pieces[k] == pieces[t] for k, (t, _, b) in rows.items() if t >= 0 and not b)


def test_connectivity_index(spark, net, rows):
    occupied = {k: 1.0 + k % 3 for k in rows if k % 2}
    w = spark.createDataFrame(list(occupied.items()), "id long, weight double")
    got = H.connectivity_index(net, w, 0.5, 0.1, 0.9, 0.8).first()
    total = 0.0
    for a in occupied:
        for b in occupied:
            if a == b:
                total += occupied[a] * occupied[b]
                continue
            pa, pb = path(rows, a), path(rows, b)
            common = [x for x in pa if x in pb]
            if common:
                way = pa[: pa.index(common[0])] + [common[0]] + pb[: pb.index(common[0])]
                total += occupied[a] * occupied[b] * 0.72 ** (len(way) - 1) * 0.5 ** (0.1 * sum(rows[x][1] for x in way))
    assert math.isclose(got["pci"], total / sum(occupied.values()) ** 2, rel_tol=1e-9)
    assert H.connectivity_index(net, w.limit(1)).first()["pci"] == 0.0


def test_gaps_need_both_sides_and_a_limit(spark):
    # 4 -> 3 -> 2 -> 1 -> 0
    line = N.RiverNetwork(spark.createDataFrame([(k, k - 1, 10.0) for k in range(5)], "subc_id long, target long, length double"))
    good = spark.createDataFrame([(1,), (3,)], "id long")
    assert [r["id"] for r in H.fill_habitat_gaps(line, good, max_gap=10.0).collect()] == [2]
    assert H.fill_habitat_gaps(line, good, 9.0, 10.0).collect() == []
    with pytest.raises(ValueError, match="limit"):
        H.fill_habitat_gaps(line, good)


def test_budget_walk(spark):
    # two branches 2 and 3 into 1, 1 into 0
    net = N.RiverNetwork(spark.createDataFrame([(0, -1, 10.0), (1, 0, 10.0), (2, 1, 10.0), (3, 1, 4.0)], "subc_id long, target long, length double"))
    at = spark.createDataFrame([("a", 1, 0.5)], "start string, id long, fraction double")
    got = {r["id"]: (round(r["fraction_start"], 6), round(r["fraction_end"], 6)) for r in H.walk_budget(net, at, 10.0, 7.0).collect()}
    assert got == {1: (0.0, 1.0), 2: (0.5, 1.0), 3: (0.0, 1.0), 0: (0.0, 0.2)}
    assert H.walk_budget(net, at).collect() == []


def test_neighbours_focal_flag(spark, net, rows):
    values = spark.createDataFrame([(k, float(k)) for k in rows], "id long, v double")
    pairs = N.neighbours(net, 2)
    assert {(r["id"], r["neighbour"]) for r in pairs.collect()} == {(b, s) for s in rows for b in path(rows, s)[1:3]}
    focal = {r["id"]: r["v"] for r in N.neighbour_variable(pairs, values, ["v"], "mean", compat_focal=True).collect()}
    assert all(v == k for k, v in focal.items())


def test_spanning_subnetwork(spark, net, rows):
    points = [k for k in rows if k % 5 == 4]
    got = {r["id"] for r in H.spanning_subnetwork(net, spark.createDataFrame([(k,) for k in points], "id long"), 0).collect()}
    want = set(points)
    for a in points:
        for b in points:
            pa, pb = path(rows, a), path(rows, b)
            common = [x for x in pa if x in pb]
            if common and a != b:
                want |= {*pa[: pa.index(common[0]) + 1], *pb[: pb.index(common[0]) + 1]}
    assert got == want


def test_fragmentation_index(spark):
    v = spark.createDataFrame([("a", "current", 0.5), ("a", "future", 0.25), ("b", "current", 0.0)], "species string, scenario string, pci double")
    assert {r["species"]: r["fi"] for r in H.fragmentation_index(v).collect()} == {"a": 50.0, "b": None}


def test_pfafstetter(spark):
    # stem 0 <- 1 <- 2 <- 3 <- 4 <- 5, tributaries 10-14 at 0..4, each of another size; 12 is the smallest
    rows = [(0, -1, 1.0)] + [(k, k - 1, 1.0) for k in range(1, 5)] + [(5, 4, 100.0)] + [(10, 0, 5.0), (11, 1, 6.0), (12, 2, 1.0), (13, 3, 7.0), (14, 4, 8.0)]
    net = N.RiverNetwork(spark.createDataFrame(rows, "subc_id long, target long, area double"))
    got = {r["id"]: r["code"] for r in pfafstetter(net).collect()}
    assert got == {0: 1, 10: 2, 1: 3, 11: 4, 2: 5, 12: 5, 3: 5, 13: 6, 4: 7, 14: 8, 5: 9}
    with pytest.raises(ValueError, match="outlet"):
        pfafstetter(N.RiverNetwork(spark.createDataFrame([(1, -1, 1.0), (2, -1, 1.0)], "subc_id long, target long, area double")))


def _tree(spark, pairs):
    """(id, target, length) rows as a network."""
    return N.RiverNetwork(spark.createDataFrame(pairs, "subc_id long, target long, length double"))


def _random_forest(seed, n=40, roots=2):
    rng = random.Random(seed)
    return [(k, -1 if k < roots else rng.randrange(k), rng.randint(1, 9) + 0.5) for k in range(n)]


def _ways(rows):
    """(i, j) -> segments on the way between them, both ends included, for all connected pairs."""
    down = {i: t for i, t, _ in rows}

    def path(i):
        out = [i]
        while down[out[-1]] >= 0:
            out.append(down[out[-1]])
        return out

    ways = {}
    for i in down:
        for j in down:
            a, b = path(i), path(j)
            if a[-1] == b[-1]:
                meet = next(x for x in a if x in b)
                ways[i, j] = a[: a.index(meet)] + [meet] + b[: b.index(meet)][::-1]
    return ways


def test_centrality_of_all_modes_against_all_ways(spark):
    rows = _random_forest(3)
    net, length, ways = _tree(spark, rows), {i: w for i, _, w in rows}, _ways(_random_forest(3))
    # an edge weighs as its upper end: the way's segments but the meeting one
    down = {i: t for i, t, _ in rows}

    def dist(way):
        return sum(length[x] for k, x in enumerate(way) if (k + 1 < len(way) and down[x] == way[k + 1]) or (k and down[x] == way[k - 1]))

    got = {r["subc_id"]: r for r in N.centrality(net, "all").collect()}
    for i in length:
        far = [dist(w) for (a, b), w in ways.items() if a == i and b != i]
        assert got[i]["farness"] == pytest.approx(sum(far)) and got[i]["eccentricity"] == pytest.approx(max(far))
        assert got[i]["degree"] == sum(t == i for t in down.values()) + (down[i] >= 0)
    out = {r["subc_id"]: r for r in N.centrality(net, "out").collect()}
    for i in length:
        way = [w for (a, b), w in ways.items() if a == i and all(down[x] == y for x, y in zip(w, w[1:])) and b != i]
        assert (out[i]["farness"] or 0) == pytest.approx(sum(dist(w) for w in way))


def test_connectivity_against_the_matrix(spark):
    rows = [(i, t, w, 0.0 if i == 11 else 0.9, 1.0 - i / 100) for i, t, w in _random_forest(5)]
    net = N.RiverNetwork(spark.createDataFrame(rows, "subc_id long, target long, length double, up double, down double"))
    ways, down = _ways([r[:3] for r in rows]), {r[0]: r[1] for r in rows}
    c, length = {r[0]: r[3] * r[4] for r in rows}, {r[0]: r[2] for r in rows}
    weight = {i: float(1 + i % 3) for i in down if i % 4 != 1}

    def m(i, j):
        if i == j:
            return 1.0
        if (i, j) not in ways:
            return 0.0
        way = ways[i, j]
        out = 0.8 ** sum(length[x] for x in way)
        for x, y in zip(way, way[1:], strict=False):
            out *= c[x] if down[x] == y else c[y]
        return out

    w = spark.createDataFrame(list(weight.items()), "id long, weight double")
    total = sum(weight.values())
    num = {i: sum(m(i, j) * weight[j] for j in weight) for i in weight}
    r = H.connectivity_index(net, w, 0.8, 1.0, "up", "down").first()
    assert r["n"] == len(weight) and r["pairs"] == sum((i, j) in ways for i in weight for j in weight if i < j)
    assert r["pci"] == pytest.approx(sum(num[i] * weight[i] for i in weight) / total**2)
    for r in H.reach_connectivity(net, w, 0.8, 1.0, "up", "down").collect():
        assert r["num"] == pytest.approx(num.get(r["id"], 0.0)) and r["pci"] == pytest.approx(num.get(r["id"], 0.0) / total)
    few = H.reach_connectivity(net, w.limit(1), 0.8).collect()
    assert len(few) == len(rows) and all(r["pci"] == 0 and r["den"] == 0 for r in few)


def test_orders_of_a_deep_and_of_a_wide_network(spark):
    chain = [(k, k - 1 if k else -1, 1.0) for k in range(200)] + [(1000 + k, k, 1.0) for k in range(0, 200, 2)]
    got = {r["id"]: (r["strahler"], r["shreve"]) for r in N.stream_orders(_tree(spark, chain)).collect()}
    assert got[0] == (2, 101) and got[199] == (1, 1) and got[198] == (2, 2) and got[1000] == (1, 1)
    wide = spark.range(1, 20_001).selectExpr("id AS subc_id", "cast(0 as long) AS target", "1.0D AS length").unionByName(spark.sql("SELECT cast(0 as long) AS subc_id, cast(-1 as long) AS target, 1.0D AS length"))
    net = N.RiverNetwork(wide)
    assert {r["strahler"] for r in N.stream_orders(net).where("id = 0").collect()} == {2}
    top = N.centrality(net).where("subc_id = 0").first()
    assert top["farness"] == 20_000 and top["degree"] == 20_000


def test_statistics_of_repeated_and_missing_values(spark):
    net = _tree(spark, [(0, -1, 1.0), (1, 0, 1.0), (2, 0, 1.0), (3, 1, 1.0)])
    values = spark.createDataFrame([(3, 1.0), (3, 4.0), (2, None), (1, 7.0)], "id long, v double")
    for stat, want in {"sum": {0: 12.0, 1: 5.0, 2: 0.0, 3: 5.0}, "mean": {0: 4.0, 1: 2.5, 2: None, 3: 2.5}, "max": {0: 7.0, 1: 4.0, 2: None, 3: 4.0}, "sd": {0: 3.0, 1: 2.121320, 2: None, 3: 2.121320}}.items():
        got = {r["base"]: r["v"] for r in N.upstream_variable(net, values, ["v"], stat).collect()}
        assert got == {k: x if x is None else pytest.approx(x, abs=1e-5) for k, x in want.items()}
