"""Stored connections: the pairs (base, stream) of a network as a bucketed table that later statistics join without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators.network import RiverNetwork, closure, headwaters, walk_down


def _save(pairs: DataFrame, name: str, buckets: int, mode: str) -> None:
    # one task a bucket, so that each write adds one file to it
    dealt = pairs.select("base", "stream", "hops").repartition(buckets, "stream")
    dealt.write.format("parquet").mode(mode).bucketBy(buckets, "stream").sortBy("stream").saveAsTable(name)


def store_connections(net: RiverNetwork, name: str, buckets: int = 64, seeds: DataFrame | None = None) -> DataFrame:
    """Saves (base, stream, hops) of every base, or of the ``seeds`` (id), as table ``name``, bucketed and sorted by stream.

    A segment stands above itself at 0 hops. The table replaces one of that name.
    """
    spark = net.edges.sparkSession
    _save(closure(net, include_self=True, seeds=seeds), name, buckets, "overwrite")
    return spark.table(name)


def buckets_of(spark: SparkSession, name: str) -> int:
    found = [r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r["col_name"] == "Num Buckets"]
    if not found:
        raise ValueError(f"{name} is no table of connections")
    return int(found[0])


def extend_connections(net: RiverNetwork, name: str, added: DataFrame) -> DataFrame:
    """Adds the pairs of the ``added`` segments (id) only; ``net`` is the network with them.

    Added segments lie above the known ones or form basins of their own: a known
    segment must not drain into an added one, as its pairs would change
    (ValueError). Segments that the table has already are not added again.
    """
    spark = net.edges.sparkSession
    table = spark.table(name)
    new = added.select(F.col("id").cast("long").alias("id")).distinct().join(table.where("hops = 0").select(F.col("stream").alias("id")), "id", "left_anti")
    known = net.edges.join(new, "id", "left_anti")
    if not known.join(new.select(F.col("id").alias("target")), "target", "left_semi").isEmpty():
        raise ValueError("a known segment drains into an added one")
    # the ways down from the added segments are the bases they stand above
    pairs = walk_down(net, new).select(F.col("stream").alias("base"), F.col("base").alias("stream"), "hops")
    _save(pairs, name, buckets_of(spark, name), "append")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def load_connections(spark: SparkSession, name: str, include_focal: bool = False, net: RiverNetwork | None = None) -> DataFrame:
    """(base, stream) as ``upstream_variable`` takes them; with ``net`` its headwaters stand above themselves even without the focal segment."""
    table = spark.table(name)
    pairs = table if include_focal else table.where("hops > 0")
    pairs = pairs.select("base", "stream")
    if net is not None and not include_focal:
        pairs = pairs.unionByName(headwaters(net).select(F.col("id").alias("base"), F.col("id").alias("stream")))
    return pairs
