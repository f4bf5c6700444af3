"""Pfafstetter codes of one basin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thalweg.operators.network import RiverNetwork, accumulate, closure, headwaters, outlets, roots, walk_down
from thalweg.plans.scratch import apart as materialize


def pfafstetter(net: RiverNetwork, area: str = "area") -> DataFrame:
    """(id, code): 2, 4, 6, 8 for the four largest tributaries, 1 to 9 (odd) for what lies between them.

    ``net.edges`` has the area of each sub-catchment and one outlet. The main
    stem is the way from the headwater whose summed area down to the outlet is
    largest (ties to the smaller id). A tributary joins the stem from beside;
    its size is its upstream area. Even codes go up the stem; inter-basins are
    the stem's segments and small tributaries between two of the four, 1 from
    the outlet up to the first.
    """
    if outlets(net).count() != 1:
        raise ValueError("the network has not exactly one outlet")
    if net.edges.count() < 3:
        raise ValueError("the network is too small")
    sized = RiverNetwork.__new__(RiverNetwork)
    sized.edges = net.edges.select("id", "target", F.col(area).cast("double").alias("weight"))
    # summed area of the way down, the outlet's own included
    down = materialize(roots(sized), "ways")
    head = headwaters(net).join(down, "id").orderBy(F.desc("dist"), "id").limit(1)
    stem = materialize(walk_down(sized, head.select("id")).select(F.col("stream").alias("id"), F.col("hops").alias("from_head")), "stem")
    last = stem.agg(F.max("from_head").alias("m"))
    # position up the stem: 0 at the outlet
    stem = materialize(stem.join(F.broadcast(last)).select("id", (F.col("m") - F.col("from_head")).alias("pos")), "stem")
    up_area = accumulate(sized, {"up": ("weight", "sum")})
    tribs = net.links.select("id", "target").join(stem.select("id"), "id", "left_anti").join(stem.select(F.col("id").alias("target"), "pos"), "target").join(up_area, "id").select(F.col("id").alias("trib"), "pos", "up")
    four = materialize(tribs.orderBy(F.desc("up"), "trib").limit(4), "tributaries")
    numbered = four.withColumn("code", (2 * F.row_number().over(W.orderBy("pos", "trib"))).cast("int"))  # at most four rows
    numbered = materialize(numbered, "codes")
    inside = closure(net, seeds=numbered.select(F.col("trib").alias("id"))).join(numbered.select(F.col("trib").alias("base"), "code"), "base").select(F.col("stream").alias("id"), "code")
    # everything else drains to the stem at some place; its code is one more than that of the last main tributary below
    apart = RiverNetwork.__new__(RiverNetwork)
    apart.edges = net.edges.select("id", "target", "weight").join(stem.select("id", F.lit(True).alias("_stem")), "id", "left").select("id", F.when(F.col("_stem"), F.lit(-1)).otherwise(F.col("target")).alias("target"), "weight").hint("merge")
    place = roots(apart).select("id", F.col("root").alias("base")).join(stem.select(F.col("id").alias("base"), "pos"), "base").select("id", "pos")
    cuts = numbered.agg(F.sort_array(F.collect_list("pos")).alias("cuts"))
    rest = place.join(inside.select("id"), "id", "left_anti").join(F.broadcast(cuts))
    between = rest.select("id", (1 + 2 * F.size(F.filter("cuts", lambda c: c < F.col("pos")))).cast("int").alias("code"))
    return inside.unionByName(between)
