"""Centroid clustering: plain Lloyd rounds on whole numbers.

The centroids are broadcast (``k`` vectors, whatever the rows). In each round
``mapInPandas`` takes the integer squared differences to each of them in NumPy,
the first smallest wins, and every partition sums its vectors by cluster; the
sums merge through groupBy. No vector is shuffled, and as all arithmetic is in
whole numbers, the result does not depend on partitions or their order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import give_back, materialize, only
from thalweg.llm.vectors import MOST, clamp, largest, total, whole_rows

Centroids = list[list[int]]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance to it, for each row; ties go to the smaller number.

    Exact: where 64 bits might not hold a distance, Python's integers do.
    """
    if max(largest(x), largest(centroids)) > math.isqrt((1 << 61) // max(1, x.shape[1])):
        x, centroids = x.astype(object), centroids.astype(object)
    distances = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids])
    cluster = distances.argmin(axis=0)
    return cluster, distances[cluster, np.arange(len(x))]


def _vectors(frame: pd.DataFrame, rows: int = 4096) -> Iterator[tuple[slice, np.ndarray]]:
    for at in range(0, len(frame), rows):
        part = slice(at, min(at + rows, len(frame)))
        yield part, np.stack(frame["x"].iloc[part].to_numpy())


def cluster_sums(rows: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that is not empty: how many rows (vec_id, x) it has and their sum, exact."""
    spark, k, size = rows.sparkSession, len(centroids), len(centroids[0])
    shared = spark.sparkContext.broadcast(np.array(centroids, np.int64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only()
        sums, counts = np.zeros((k, size), object), [0] * k
        for frame in frames:
            for _, x in _vectors(frame):
                most = largest(x)
                found = nearest(x, shared.value)[0]
                for c in np.unique(found):
                    own = x[found == c]
                    sums[c] += total(own, most)
                    counts[c] += len(own)
        met = [c for c in range(k) if counts[c]]
        yield pd.DataFrame(
            {
                "cluster": np.repeat(np.array(met, np.int32), size + 1),
                "at": np.tile(np.arange(-1, size, dtype=np.int32), len(met)),
                "v": [Decimal(int(v)) for c in met for v in (counts[c], *sums[c])],
            }
        )
        give_back()

    merged = rows.select("x").mapInPandas(run, "cluster int, at int, v decimal(38,0)").groupBy("cluster", "at").agg(F.sum("v").alias("v"))
    out: dict[int, list[int]] = {}
    for r in sorted(merged.collect(), key=lambda r: (r["cluster"], r["at"])):  # k * (size + 1) numbers at most
        out.setdefault(r["cluster"], []).append(int(r["v"]))
    return {c: (v[0], v[1:]) for c, v in out.items()}


def first_centroids(rows: DataFrame, k: int, salt: str) -> Centroids:
    """The vectors of the ``k`` rows with the smallest SHA-256 of ``salt:vec_id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["x"]) for r in rows.select(digest.alias("_digest"), "x").orderBy("_digest", "x").limit(k).collect()]


def lloyd(rows: DataFrame, centroids: Centroids, rounds: int) -> Centroids:
    """Centroids after ``rounds``: each the floor of its rows' mean by component; one without rows stays."""
    for _ in range(rounds if centroids else 0):
        found = cluster_sums(rows, centroids)
        centroids = [[v // found[c][0] for v in found[c][1]] if c in found else old for c, old in enumerate(centroids)]
    return centroids


def assign(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster, distance (squared) of each row (vec_id, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only()
        for frame in frames:
            for part, x in _vectors(frame):
                cluster, distance = nearest(x, shared.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"].iloc[part].to_numpy(), "cluster": cluster.astype(np.int32), "distance": clamp(distance)})
        give_back()

    # an id that is null would turn the ids of a pandas column into doubles
    named = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x")
    return named.mapInPandas(run, "vec_id string, cluster int, distance long").select(F.col("vec_id").cast("long").alias("vec_id"), "cluster", "distance")


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: float = 64.0, salt: str = "1") -> tuple[DataFrame, Centroids]:
    """Clusters of the rows (vec_id, embedding): (vec_id, cluster, distance) and the final centroids.

    Kept are vectors of exactly ``size`` components, none null or non-finite;
    each component c becomes floor(scale * c). One row for each kept row,
    repeated rows and ids included; rows without an id count like the others (as
    if their id were empty where the first centroids are chosen; equal digests go
    by the vectors). With fewer than ``k`` kept rows each is a centroid; an empty
    table gives no rows and no centroids. Components and distances that 64 bits
    cannot hold are given as the nearest long; comparisons are exact. Other
    columns are not looked at.
    """
    rows = materialize(whole_rows(vectors, scale).where(F.size("x") == size), "vectors")
    centroids = lloyd(rows, first_centroids(rows, k, salt), rounds)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    return materialize(assign(rows, centroids), "assigned"), centroids


def with_inertia(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia (sums of distance) and centroid_sha256 (components in decimal, comma-joined)."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: int(r["v"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("v")).collect()}  # one a centroid at most
    every = min(MOST, sum(sums.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, min(MOST, v), every, digests[c]) for c, v in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
