"""Helpers of the operators on embeddings: whole-number vectors and exact sums over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import give_back, only, partitions, small_batches

#: Largest value of a long; larger exact results are given as this one.
MOST = (1 << 63) - 1


def whole_rows(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, x: floor(scale * c) of each component c as a double, in 64 bits.

    Rows whose vector is null, empty or holds null or non-finite entries are
    left out. Products beyond 64 bits become the nearest long.
    """
    c = F.col("embedding").cast("array<double>")
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0)).where(finite)
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * F.lit(float(scale)))).alias("x"))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """The vectors of a batch, all of one length, as rows of a matrix."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def total(x: np.ndarray, most: int) -> np.ndarray:
    """Sums over the rows of a matrix with entries of at most ``most``, as Python's integers."""
    return x.sum(axis=0, dtype=np.int64 if most * len(x) < MOST else object).astype(object)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def clamp(values: np.ndarray) -> np.ndarray:
    """Exact whole numbers as longs; those that do not fit become the largest long."""
    return np.array([min(int(v), MOST) for v in values], np.int64) if values.dtype == object else values


def add_up(rows: DataFrame, look: Callable[[pa.RecordBatch], np.ndarray]) -> list[int]:
    """Exact sums of the arrays that ``look`` gives for bounded batches: summed in each partition, merged by place through groupBy.

    What reaches the driver has the length of such an array, whatever the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        sums = None
        for batch in small_batches(batches):
            part = look(batch)
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.record_batch([pa.array(np.arange(len(sums)), pa.int64()), pa.array([Decimal(int(v)) for v in sums], pa.decimal128(38, 0))], names=["at", "v"])
        give_back()

    found = rows.mapInArrow(run, "at long, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()
    return [int(r["v"]) for r in sorted(found, key=lambda r: r["at"])]


def float_sums(rows: DataFrame, look: Callable[..., np.ndarray], *shared, chunk: int = 4096) -> np.ndarray:
    """Sums of the arrays ``look(batch, *shared)`` of bounded batches: summed in each partition, then chunk by chunk; empty without rows.

    ``shared`` is broadcast. Doubles are added in no fixed order, so sums agree
    between layouts to rounding.
    """
    held = rows.sparkSession.sparkContext.broadcast(shared)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        sums = None
        for batch in small_batches(batches):
            one = look(batch, *held.value)
            sums = one if sums is None else sums + one
        if sums is not None:
            cuts = range(0, len(sums), chunk)
            yield pa.record_batch([pa.array(list(cuts), pa.int64()), pa.array([sums[k : k + chunk].tobytes() for k in cuts], pa.binary())], names=["at", "v"])
        give_back()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, v in zip(batch.column("at").to_pylist(), batch.column("v").to_pylist(), strict=True):
                sums[at] = sums.get(at, 0.0) + np.frombuffer(v)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["at", "v"])

    schema = "at long, v binary"
    found = rows.mapInArrow(part, schema).repartition(partitions(rows.sparkSession), "at").mapInArrow(unite, schema).collect()
    return np.concatenate([np.zeros(0), *(np.frombuffer(r["v"]) for r in sorted(found, key=lambda r: r["at"]))])
