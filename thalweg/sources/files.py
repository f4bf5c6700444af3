"""Delimited tables, tiles by name pattern, tagged unions, and one writer for several formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators.grid import COMPRESSION


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text under a stated schema; ids with leading zeros are read as strings by saying so."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def read_tiles(spark: SparkSession, root: str, variable: str, tiles: list[str], schema: str, sep: str = " ") -> DataFrame:
    """<variable>_<tile>.txt anywhere below a folder, with a tile column; tiles without a file raise."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{variable}_{{{','.join(tiles)}}}.txt").csv(root, schema=schema, sep=sep, header=True)
    df = found.withColumn("tile", F.regexp_extract(F.input_file_name(), r"_(h\d\dv\d\d)\.txt$", 1))
    there = {r["tile"] for r in df.select("tile").distinct().collect()}
    if missing := [t for t in tiles if t not in there]:
        raise FileNotFoundError(f"no {variable} table for {missing}; zipped ones must be unpacked first")
    return df


def read_tagged(spark: SparkSession, files: list[tuple[str, str, str]], schema: str, sep: str = ",") -> DataFrame:
    """Union of files given as (path, status, stage), each row tagged with both."""
    parts = [spark.read.csv(p, schema=schema, sep=sep, header=True).withColumn("status", F.lit(s)).withColumn("stage", F.lit(g)) for p, s, g in files]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def save(df: DataFrame, path: str, save_function=None, compression: str = "low") -> None:
    """By the ending: .csv, .tsv, .txt, .json, .geojson (a text column ``feature``), .orc, else Parquet; or a function of (df, path)."""
    if save_function is not None:
        save_function(df, path)
        return
    if compression not in COMPRESSION:
        raise ValueError(f"compression is one of {sorted(COMPRESSION)}")
    kind, w = path.rsplit(".", 1)[-1].lower(), df.write.mode("overwrite")
    if kind in ("csv", "tsv", "txt"):
        w.csv(path, header=True, sep={"csv": ",", "tsv": "\t", "txt": " "}[kind])
    elif kind == "geojson":
        df.select("feature").write.mode("overwrite").text(path)
    elif kind in ("json", "orc"):
        getattr(w, kind)(path)
    else:
        w.option("compression", {"none": "uncompressed"}.get(COMPRESSION[compression], COMPRESSION[compression])).parquet(path)


def split_files(df: DataFrame, order: list[str], size: int, path: str) -> None:
    """One folder for each chunk of ``size`` rows."""
    from thalweg.operators.tables import chunked

    chunked(df, order, size).drop("row_no").write.mode("overwrite").partitionBy("chunk").csv(path, header=True)
