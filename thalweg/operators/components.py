"""Connected components of undirected links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.plans.scratch import apart as materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its smallest node.

    Each round points every node to its smallest neighbour (or itself), jumps
    the pointers twice, renames the links' ends and keeps the distinct links
    whose ends still differ, so the links shrink quickly; the names found so far
    are renamed along. Only whether links are left reaches the driver.
    """
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    names = None
    for _ in range(rounds):
        if links.isEmpty():
            break
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = materialize(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up")), "up")
        for _ in range(2):
            to = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(to, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        up = materialize(up, "up")
        to_a, to_b = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        links = links.join(to_a, "a").join(to_b, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).where("a < b").distinct()
        links = materialize(links, "links")
        if names is None:
            names = up.select("node", F.col("up").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), F.col("up").alias("next"))
            names = materialize(names.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "names")
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")) if names is None else names
