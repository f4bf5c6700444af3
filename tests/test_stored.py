"""Stored connections: equal to the closure, extended by what is new, joined without an exchange on their side."""

import random

import pytest
from pyspark.sql import functions as F

from thalweg.operators import network as N
from thalweg.operators import stored as C


def network(spark, parent):
    return N.RiverNetwork(spark.createDataFrame([(k, t, 1.0) for k, t in parent.items()], "subc_id long, target long, length double"))


def pairs_of(parent):
    out = set()
    for k in parent:
        at, hops = k, 0
        while at >= 0:
            out.add((at, k, hops))
            at, hops = parent[at], hops + 1
    return out


@pytest.fixture(scope="module")
def parent():
    rng = random.Random(4)
    return {k: rng.randrange(max(0, k - 7), k) if k % 30 else -1 for k in range(120)}


def test_stored_and_extended(spark, parent):
    old = {k: t for k, t in parent.items() if k < 80}
    got = C.store_connections(network(spark, old), "connections_a", 4)
    assert {tuple(r) for r in got.collect()} == pairs_of(old)
    net = network(spark, parent)
    added = spark.createDataFrame([(k,) for k in range(70, 120)], "id long")  # ten of them are there already
    got = C.extend_connections(net, "connections_a", added).collect()
    assert len(got) == len(pairs_of(parent)) and {tuple(r) for r in got} == pairs_of(parent)
    assert len(C.extend_connections(net, "connections_a", added).collect()) == len(got)
    turned = network(spark, {**parent, 0: 500, 500: -1})
    with pytest.raises(ValueError, match="drains"):
        C.extend_connections(turned, "connections_a", spark.createDataFrame([(500,)], "id long"))
    assert C.buckets_of(spark, "connections_a") == 4
    spark.sql("DROP TABLE connections_a")


def test_statistics_join_them_without_an_exchange(spark, parent):
    net = network(spark, parent)
    C.store_connections(net, "connections_b", 4)
    values = spark.createDataFrame([(k, float(k * k % 17)) for k in parent], "id long, v double")
    stat = lambda c: F.max(c) - F.min(c)
    for focal in (True, False):
        got = N.upstream_variable(net, values, ["v"], stat, connections=C.load_connections(spark, "connections_b", focal, net))
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in N.upstream_variable(net, values, ["v"], stat, include_focal=focal).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = N.upstream_variable(net, values, ["v"], stat, connections=C.load_connections(spark, "connections_b"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = plan[plan.index("SortMergeJoin") :]
    assert "Bucketed: true" in join
    side = join[: join.index("Bucketed: true")]
    assert "Exchange" not in side  # the stored side comes first, straight from the scan
    spark.sql("DROP TABLE connections_b")
