"""Intermediate tables in the folder that the session shares."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame, mb: float = 4.0) -> int:
    """A number of partitions that grows with the files ``df`` is read from: one for ``mb`` MB of them, those of a shuffle at least.

    Adaptive execution joins partitions by their compressed size; ids and cells
    take twenty times that in a hash table, so a task's memory would grow.
    """
    spark = df.sparkSession
    conf, total = spark._jsparkSession.sessionState().newHadoopConf(), 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(partitions(spark), math.ceil(total / (mb * 1e6)))


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local master (tests on one machine).

    On a cluster a local folder would be another on each machine, so there a
    folder must be named.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="thalweg-"))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


_PATHS: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{scratch_root(spark)}/thalweg-{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Deletes what this process wrote; to be called when no DataFrame made from it is needed any more."""
    conf, gone = spark._jsparkSession.sessionState().newHadoopConf(), 0
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for tables that grow with the input: joins shuffle them, they are never collected for a broadcast.

    Spark takes a file's compressed size for the table's; ids and distances
    take ten times that in memory, in the driver and in each executor.
    """
    return materialize(df, name).hint("merge")
