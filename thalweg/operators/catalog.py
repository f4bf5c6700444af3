"""Catalog of tiled datasets: names taken apart, subsets, download sizes, available components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name grammars of the datasets.
TILE = r"h\d\dv\d\d"
LAND_COVER = r"^(c\d+)_(\d{4})_(h\d\dv\d\d)\.\w+$"
PROJECTED = r"^(.+)_(\d{4}-\d{4})_(.+)_(ssp\d{3}|rcp\d\d)_(V\.\d\.\d)_(h\d\dv\d\d)\.\w+$"
#: Numbers of the regional units.
REGIONAL_UNITS = (*range(1, 117), *range(150, 201))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """file_path;file_id;file_size with the name taken from the path."""
    return with_names(spark.read.csv(path, sep=";", header=True, schema="file_path string, file_id string, file_size long"))


def with_names(catalog: DataFrame) -> DataFrame:
    """Adds file_name, var, tile and format."""
    name = F.element_at(F.split("file_path", "/"), -1)
    return catalog.withColumn("file_name", name).withColumn("var", F.regexp_replace("file_name", r"_[^_]+$", "")).withColumn("tile", F.nullif(F.regexp_extract("file_name", rf"_({TILE})\.", 1), F.lit(""))).withColumn("format", F.element_at(F.split("file_name", r"\."), -1))


def variables(catalog: DataFrame, contains: str | None = None) -> DataFrame:
    """Distinct variable names, those whose path holds the text."""
    c = catalog if contains is None else catalog.where(F.contains("file_path", F.lit(contains)))
    return c.select("var").distinct()


def land_cover_parts(catalog: DataFrame) -> DataFrame:
    """base_var, year, tile of land-cover files."""
    part = lambda k: F.regexp_extract("file_name", LAND_COVER, k)
    return catalog.where(F.col("file_name").rlike(LAND_COVER)).select("file_name", "file_size", part(1).alias("base_var"), part(2).cast("int").alias("year"), part(3).alias("tile"))


def projected_parts(catalog: DataFrame) -> DataFrame:
    """base_var, period, model, scenario, version, tile of projected-climate files."""
    part = lambda k: F.regexp_extract("file_name", PROJECTED, k)
    return catalog.where(F.col("file_name").rlike(PROJECTED)).select("file_name", "file_size", *[part(k + 1).alias(n) for k, n in enumerate(("base_var", "period", "model", "scenario", "version", "tile"))])


def combine(spark: SparkSession, parts: dict[str, Sequence[str]], sep: str = "_") -> DataFrame:
    """All names that the given components make (a short list by nature)."""
    df = spark.range(1).select(*[F.explode(F.array(*[F.lit(str(v)) for v in vs])).alias(n) if k == 0 else F.lit(None).cast("string").alias(n) for k, (n, vs) in enumerate(parts.items())])
    for n, vs in list(parts.items())[1:]:
        df = df.withColumn(n, F.explode(F.array(*[F.lit(str(v)) for v in vs])))
    return df.withColumn("var", F.concat_ws(sep, *parts))


def check_available(wanted: DataFrame, catalog: DataFrame, ignore_missing: bool = False) -> DataFrame:
    """The wanted variables that the catalog has; missing ones raise unless ignored."""
    missing = [r["var"] for r in wanted.join(catalog.select("var").distinct(), "var", "left_anti").select("var").take(5)]
    if missing and not ignore_missing:
        raise ValueError(f"not available: {missing}")
    return wanted.join(catalog.select("var").distinct(), "var", "left_semi")


def download_size(catalog: DataFrame, names: Sequence[str], tiles: Sequence[str]) -> DataFrame:
    """One row: files, missing, bytes of <var>_<tile>.zip; a missing file counts 0, an unknown tile is an error."""
    spark = catalog.sparkSession
    known = {r["tile"] for r in catalog.where(F.col("tile").isin(list(tiles))).select("tile").distinct().collect()}
    if unknown := [t for t in tiles if t not in known]:
        raise ValueError(f"unknown tiles {unknown}")
    wanted = combine(spark, {"v": names, "t": tiles}).select(F.concat(F.col("var"), F.lit(".zip")).alias("file_name"))
    size = catalog.where(F.col("tile").isin(list(tiles))).groupBy("file_name").agg(F.max("file_size").alias("file_size"))
    return wanted.join(size, "file_name", "left").agg(F.count("*").alias("files"), F.count_if(F.col("file_size").isNull()).alias("missing"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def tile_filesize(catalog: DataFrame, variable: str, file_format: str = "tif", tile: str | int | None = None, whole: bool = False) -> int:
    """Bytes of one tile's, regional unit's or the global file."""
    if catalog.where(F.col("var") == variable).isEmpty():
        raise ValueError(f"unknown variable {variable}")
    if whole:
        name = f"{variable}_ovr.{file_format}"
    elif variable == "regional_unit":
        if int(tile) not in REGIONAL_UNITS:
            raise ValueError(f"unknown regional unit {tile}")
        name = f"{variable}_{tile}.{file_format}"
    else:
        name = f"{variable}_{tile}.{file_format}"
    row = catalog.where(F.col("file_name") == name).select("file_size").first()
    if row is None:
        raise ValueError(f"no file {name}")
    return row[0]


def dataset_summary(catalog: DataFrame) -> DataFrame:
    """Per variable: tiles, files, bytes."""
    return catalog.groupBy("var").agg(F.count_distinct("tile").alias("tiles"), F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def with_route(catalog: DataFrame) -> DataFrame:
    """Adds the server that a file comes from: the fallback only, or the first with the fallback behind it."""
    return catalog.withColumn("route", F.when(F.col("file_name") == "cti_ovr.tif", "fallback").otherwise("first, then fallback"))


def fetch(catalog: DataFrame, get) -> list:
    """Calls ``get(file_path, file_id)`` for each file; the transfer itself is the caller's."""
    return [get(r["file_path"], r["file_id"]) for r in catalog.select("file_path", "file_id").toLocalIterator()]
