"""Cleaning of occurrence and barrier records, argument checks, local answers to remote queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def check_points(points: DataFrame, lon: str, lat: str, id: str | None = None, id_length: int = 9) -> None:
    """All argument rules in one pass; raises with everything that is wrong."""
    missing = [c for c in (lon, lat, *([id] if id else [])) if c not in points.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    rules = {
        "longitude beyond 180": F.count_if(~F.col(lon).between(-180, 180)),
        "latitude beyond 90": F.count_if(~F.col(lat).between(-90, 90)),
    }
    if id:
        rules["id too long"] = F.count_if(F.length(F.col(id).cast("string")) > id_length)
        rules["id repeated"] = F.count(id) - F.count_distinct(id)
    row = points.agg(*[c.alias(n) for n, c in rules.items()]).first()
    wrong = [n for n in rules if row[n]]
    if wrong:
        raise ValueError(", ".join(wrong))


def swap_inverted(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Exchanges the coordinates of rows that lie in the box only the other way round; then keeps those inside it."""
    xmin, ymin, xmax, ymax = box
    flipped = ~(F.col(lon).between(xmin, xmax) & F.col(lat).between(ymin, ymax)) & F.col(lat).between(xmin, xmax) & F.col(lon).between(ymin, ymax)
    out = df.select(*[F.when(flipped, F.col(lat)).otherwise(F.col(lon)).alias(c) if c == lon else F.when(flipped, F.col(lon)).otherwise(F.col(lat)).alias(c) if c == lat else F.col(c) for c in df.columns])
    return out.where(F.col(lon).between(xmin, xmax) & F.col(lat).between(ymin, ymax))


#: Coordinate uncertainties that stand for defaults.
DEFAULT_UNCERTAINTY = (301, 3036, 999, 9999)


def occurrence_metadata(df: DataFrame, year: str = "year", precision: str = "coordinatePrecision", uncertainty: str = "coordinateUncertaintyInMeters") -> DataFrame:
    """Rows with a year, a precision below 0.01 or none, an uncertainty up to 1000 m or none, and no default one."""
    return df.where(F.col(year).isNotNull() & (F.col(precision).isNull() | (F.col(precision) < 0.01)) & (F.col(uncertainty).isNull() | ((F.col(uncertainty) <= 1000) & ~F.col(uncertainty).isin(*DEFAULT_UNCERTAINTY))))


def away_from(points: DataFrame, places: DataFrame, metres: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The points that no place (lon, lat) lies within ``metres`` of, such as centroids, capitals or institutions.

    Places go to the buckets that their circle touches, also beyond the 180th
    meridian and around a pole, points meet those of their own bucket. Points
    without coordinates stay; repeated rows all stay or go.
    """
    from thalweg.operators.geometry import haversine

    size = max(metres / 100_000.0, 1e-4)  # degrees of latitude; a little more than the radius
    rows, columns = lambda y: F.floor(y / size), lambda x: F.floor(x / size)
    far = F.abs("_y") + size
    wide = F.when(far >= 90, 180.0).otherwise(F.least(F.lit(180.0), size / F.cos(F.radians(far))))
    once = lambda x: x - 360 * F.floor((x + 180) / 360)  # noqa: E731  from -180 to below 180
    around = places.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(once(F.col("lon").cast("double")).alias("_x"), F.col("lat").cast("double").alias("_y")).distinct()
    turned = around.withColumn("_turn", F.explode(F.array(*[F.lit(t) for t in (-360.0, 0.0, 360.0)]))).where((F.col("_x") + F.col("_turn") - wide <= 180) & (F.col("_x") + F.col("_turn") + wide >= -180))
    clamped = lambda x: F.greatest(F.lit(-180.0), F.least(F.lit(180.0), x))
    dealt = turned.withColumn("_i", F.explode(F.sequence(columns(clamped(F.col("_x") + F.col("_turn") - wide)), columns(clamped(F.col("_x") + F.col("_turn") + wide))))).withColumn("_j", F.explode(F.sequence(rows(F.col("_y") - size), rows(F.col("_y") + size))))
    at = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(lon).alias("_lon"), F.col(lat).alias("_lat")).distinct()
    met = at.withColumn("_i", columns(once(F.col("_lon").cast("double")))).withColumn("_j", rows(F.col("_lat"))).join(dealt, ["_i", "_j"]).where(haversine(F.col("_lon"), F.col("_lat"), F.col("_x"), F.col("_y")) <= metres)
    near = met.select("_lon", "_lat").distinct()
    return points.join(near, (F.col(lon) == F.col("_lon")) & (F.col(lat) == F.col("_lat")), "left_anti")


def occurrence_places(df: DataFrame, places: DataFrame, metres: float = 10.0, keys: Sequence[str] = ("lon", "lat", "species", "dataset", "year"), species: str = "species", order: Sequence[str] = (), lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Records with a species, away from the places, one for each combination of ``keys`` (the first by ``order``)."""
    from thalweg.operators.tables import keep_first

    named = away_from(df, places, metres, lon, lat).where(F.col(species).isNotNull() & (F.col(species) != ""))
    return keep_first(named, list(keys), list(order or keys))


def frequent(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows."""
    return df.join(df.groupBy(key).count().where(F.col("count") >= least).select(key), key, "left_semi")


def dam_registry(df: DataFrame, priority: str, power: str = "power_mw", licence: str = "licence", lon: str = "lon", lat: str = "lat", id: str = "site_id") -> DataFrame:
    """Of dams at the same place (4 decimals) the best status; a licence's power is shared out among its dams."""
    from thalweg.operators.tables import keep_first

    at = df.withColumn("_x", F.round(lon, 4)).withColumn("_y", F.round(lat, 4))
    one = keep_first(at, ["_x", "_y"], [F.col(priority).asc_nulls_last(), id]).drop("_x", "_y")
    return one.withColumn("n_dam_in_licence", F.when(F.col(licence).isNotNull(), F.count("*").over(W.partitionBy(licence))).otherwise(F.lit(1))).withColumn(f"{power}_dam", F.col(power) / F.col("n_dam_in_licence"))


def join_by_coordinates(points: DataFrame, looked_up: DataFrame, digits: int = 6, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Left join on rounded coordinates; the right side keeps one row for each place (its smallest)."""
    rest = [c for c in looked_up.columns if c not in (lon, lat)]
    right = looked_up.groupBy(F.round(lon, digits).alias("_x"), F.round(lat, digits).alias("_y")).agg(F.min(F.struct(*rest)).alias("_m")).select("_x", "_y", "_m.*")
    return points.withColumn("_x", F.round(lon, digits)).withColumn("_y", F.round(lat, digits)).join(right, ["_x", "_y"], "left").drop("_x", "_y")


def local_ids(points: DataFrame, cells: DataFrame, grid, basins: DataFrame) -> DataFrame:
    """The points with subc_id, basin_id and reg_id of the cell they lie in; ``basins`` has subc_id, basin_id, reg_id."""
    from thalweg.operators.grid import lookup

    return lookup(points, cells, grid, "subc_id").join(basins.select("subc_id", "basin_id", "reg_id"), "subc_id", "left")


def basin_ids(segments: DataFrame, basin_ids: Sequence[int], min_strahler: int = 1) -> DataFrame:
    """Per basin: number of sub-catchments and their ids, sorted."""
    return segments.where(F.col("basin_id").isin(list(basin_ids)) & (F.col("strahler") >= min_strahler)).groupBy("basin_id").agg(F.count("*").alias("num_subcatchments"), F.array_sort(F.collect_list("subc_id")).alias("subc_ids"))


def regional_units(points: DataFrame, cells: DataFrame, grid) -> DataFrame:
    """Distinct regional units at the points; 0 (ocean) and places outside go."""
    from thalweg.operators.grid import lookup

    return lookup(points, cells, grid, "reg_unit").where("reg_unit is not null and reg_unit <> 0").select("reg_unit").distinct()


def tile_ids(units: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct tiles of the regional units (table: tile, reg_unit)."""
    return table.join(units, "reg_unit", "left_semi").select("tile").distinct()


def parse_job_results(df: DataFrame, column: str = "json") -> DataFrame:
    """(basin_id, reg_id, num_subcatchments, subc_id): one row for each id in the result's JSON."""
    schema = "struct<subcatchment_ids_per_basin: array<struct<basin_id: long, reg_id: long, num_subcatchments: long, subc_ids: array<long>>>>"
    per = df.select(F.explode(F.from_json(column, schema)["subcatchment_ids_per_basin"]).alias("b"))
    return per.select("b.basin_id", "b.reg_id", "b.num_subcatchments", F.explode_outer("b.subc_ids").alias("subc_id"))


def points_geojson(points: DataFrame, id: str = "site_id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON feature text for each point."""
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates")).alias("geometry"), F.struct(F.col(id).cast("string").alias("site_id")).alias("properties"))).alias("feature"))
