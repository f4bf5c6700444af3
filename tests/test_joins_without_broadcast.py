"""Tables that grow with the input are shuffled in joins, never collected in the driver for a broadcast."""

from thalweg.operators import habitat as H
from thalweg.operators import network as N
from thalweg.plans.scratch import apart


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scratch_tables_of_growing_size_are_not_broadcast(spark):
    a = apart(spark.range(100).withColumnRenamed("id", "node"), "left")
    b = apart(spark.range(50).withColumnRenamed("id", "node"), "right")
    joined = a.join(b.groupBy("node").count(), "node")
    assert "Broadcast" not in _plan(joined)
    assert joined.count() == 50


def test_networks_are_not_broadcast(spark):
    net = N.RiverNetwork(spark.range(1, 64).selectExpr("id AS subc_id", "id div 2 AS target", "1.0 AS length"))
    for df in (net.links, N.roots(net), N.accumulate(net, {"n": ("weight", "sum")}, include_focal=False), N.centrality(net, "all")):
        assert "Broadcast" not in _plan(df)
    assert {r["id"]: r["hops"] for r in N.roots(net).collect()}[63] == 5


def test_weights_and_flows_of_a_network_are_not_broadcast(spark, monkeypatch):
    net = N.RiverNetwork(spark.range(1, 64).selectExpr("id AS subc_id", "id div 2 AS target", "1.0 AS length"))
    plans = []
    monkeypatch.setattr(H, "materialize", lambda df, name, write=H.materialize: plans.append(_plan(df)) or write(df, name))
    index = H.connectivity_index(net, spark.range(32, 64).selectExpr("id", "1.0 AS weight"))
    assert len(plans) == 2 and not any("Broadcast" in plan for plan in plans)
    assert _plan(index).count("BroadcastExchange") == 1  # of two tables of one row each
    assert index.first()["pairs"] == 32 * 31 // 2
