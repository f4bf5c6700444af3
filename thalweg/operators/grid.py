"""Rasters as tables of cells (cell_row, cell_col, value): lookup, zonal statistics, reclassing, crop, mosaic, focal, flow."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.plans.scratch import tasks_for

ROW, COL = "cell_row", "cell_col"
#: Integer types of rasters and their ranges.
INTEGER_TYPES = {"Byte": (0, 255), "Int16": (-32768, 32767), "UInt16": (0, 65535), "Int32": (-2147483648, 2147483647), "UInt32": (0, 4294967295), "CInt16": (-32768, 32767), "CInt32": (-2147483648, 2147483647)}
#: Compression levels and what they stand for.
COMPRESSION = {"none": "none", "low": "snappy", "high": "zstd"}


@dataclass(frozen=True)
class Grid:
    """Upper left corner and cell size of a raster, in degrees, and its NoData value."""

    x0: float = -180.0
    y0: float = 90.0
    dx: float = 1 / 1200
    dy: float = 1 / 1200
    nodata: float | None = None

    def row(self, lat: Column) -> Column:
        return F.floor((F.lit(self.y0) - lat) / F.lit(self.dy))

    def col(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.x0)) / F.lit(self.dx))

    def lat(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + 0.5) * F.lit(self.dy)

    def lon(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + 0.5) * F.lit(self.dx)


def lookup(points: DataFrame, cells: DataFrame, grid: Grid, out: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The points with the value of the cell they lie in; null outside or on NoData."""
    p = points.withColumn("_r", grid.row(F.col(lat))).withColumn("_c", grid.col(F.col(lon)))
    c = cells.select(F.col(ROW).alias("_r"), F.col(COL).alias("_c"), F.col("value").alias(out))
    return p.join(c, ["_r", "_c"], "left").drop("_r", "_c")


def extract_ids(cells: DataFrame, points: DataFrame | None = None, grid: Grid | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Without points the raster's distinct values; else the distinct points with subcatchment_id."""
    if points is None:
        return cells.where("value is not null").select("value").distinct()
    return lookup(points.distinct(), cells, grid or Grid(), "subcatchment_id", lon, lat)


def zonal_stats(cells: DataFrame, zone: str = "zone", value: str = "value", zones: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """Per zone: data and NoData cells, min, max, range, mean, mean of absolutes, population sd and variance, cv in percent, sums."""
    c = cells if zones is None else cells.join(zones.select(zone).distinct(), zone, "left_semi")
    v = F.col(value).cast("double")
    stats = c.groupBy(zone).agg(
        F.count(value).alias("data_cells"), F.count_if(F.col(value).isNull()).alias("nodata_cells"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"), F.avg(v).alias("mean"), F.avg(F.abs(v)).alias("mean_abs"),
        F.stddev_pop(v).alias("sd"), F.var_pop(v).alias("var"), F.try_divide(100 * F.stddev_pop(v), F.abs(F.avg(v))).alias("cv"), F.sum(v).alias("sum"), F.sum(F.abs(v)).alias("sum_abs"),
    )
    return stats.select(zone, *[F.col(x).alias(f"{prefix}{x}") for x in stats.columns if x != zone])


def zonal_table(zones: DataFrame, variables: dict[str, DataFrame], zone: str = "zone") -> DataFrame:
    """Zonal statistics of several co-registered rasters side by side, prefixed by the variable."""
    parts = [zonal_stats(overlay(zones, cells), zone, "value", prefix=f"{name}_") for name, cells in variables.items()]
    return reduce(lambda a, b: a.join(b, zone, "full"), parts)


def overlay(zones: DataFrame, cells: DataFrame) -> DataFrame:
    """Co-registered cells of both."""
    return zones.join(cells.select(ROW, COL, "value"), [ROW, COL])


def reclass(cells: DataFrame, table: DataFrame, old: str = "rast_val", new: str = "new_val", remaining: str | None = None, remaining_value: int = -9999, type: str = "Int32") -> DataFrame:
    """Integer lookup of the values; what the table lacks becomes null, stays (``same``) or takes one ``value``."""
    if type not in INTEGER_TYPES:
        raise ValueError(f"unknown type {type}")
    for c in (old, new):
        if table.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise ValueError(f"{c} is no integer")
    t = table.select(F.col(old).cast("long").alias("value"), F.col(new).cast("long").alias("_new"), F.lit(True).alias("_in"))
    rest = {None: F.lit(None), "same": F.col("value"), "value": F.lit(remaining_value)}[remaining]
    low, high = INTEGER_TYPES[type]
    out = F.when(F.col("_in"), F.col("_new")).when(F.col("value").isNotNull(), rest.cast("long"))
    return cells.withColumn("value", F.col("value").cast("long")).join(t, "value", "left").select(ROW, COL, F.when(out.between(low, high), out).alias("value"))


def crop(cells: DataFrame, grid: Grid, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Cells whose centre lies in the box."""
    return cells.where(grid.lon(F.col(COL)).between(xmin, xmax) & grid.lat(F.col(ROW)).between(ymin, ymax))


def extent(cells: DataFrame, grid: Grid) -> DataFrame:
    """One row: xmin, ymin, xmax, ymax of the cells' edges."""
    m = cells.agg(F.min(ROW).alias("r0"), F.max(ROW).alias("r1"), F.min(COL).alias("c0"), F.max(COL).alias("c1"))
    return m.select((grid.x0 + F.col("c0") * grid.dx).alias("xmin"), (grid.y0 - (F.col("r1") + 1) * grid.dy).alias("ymin"), (grid.x0 + (F.col("c1") + 1) * grid.dx).alias("xmax"), (grid.y0 - F.col("r0") * grid.dy).alias("ymax"))


def mosaic(tiles: Sequence[DataFrame]) -> DataFrame:
    """Tiles laid over each other; where several have data the last wins."""
    every = reduce(DataFrame.unionByName, [t.select(ROW, COL, "value", F.lit(k).alias("_k")) for k, t in enumerate(tiles)])
    # a tile may be a part of a table that another is a part of too
    n = max(tasks_for(t) for t in tiles)
    return every.repartition(n, ROW, COL).groupBy(ROW, COL).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("_k")).otherwise(F.lit(-1))).alias("value"))


def set_no_data(cells: DataFrame, value: float) -> DataFrame:
    return cells.withColumn("value", F.nullif(F.col("value"), F.lit(value)))


def report_no_data(rasters: dict[str, Grid], spark) -> DataFrame:
    return spark.createDataFrame([(n, g.nodata) for n, g in rasters.items()], "Raster string, NoData double")


_OFFSETS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _sent_around(cells: DataFrame, *keys: str, block: int = 64) -> DataFrame:
    """Each cell sent to the nine cells around it: keys..., cell_row, cell_col, centre (it is its own), and the cell's other columns.

    Cells are dealt by blocks, those on a block's rim to its neighbours too, and
    sent within their block only: what is shuffled is the cells and the rims,
    and rows of one key and cell stand in one task, as grouping by ``keys``,
    _bi, _bj, cell_row and cell_col needs them.
    """
    rest = [c for c in cells.columns if c not in (ROW, COL, *keys)]
    blocks = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / block), F.floor((F.col(c) + 1) / block)))
    dealt = cells.withColumn("_bi", blocks(ROW)).withColumn("_bj", blocks(COL)).repartition(tasks_for(cells), *keys, "_bi", "_bj")
    sent = dealt.select(*keys, "_bi", "_bj", F.explode(F.array(*[F.struct((F.col(ROW) + i).alias(ROW), (F.col(COL) + j).alias(COL), F.lit(i == 0 and j == 0).alias("centre")) for i, j in _OFFSETS])).alias("to"), *rest)
    own = (F.floor(F.col(f"to.{ROW}") / block) == F.col("_bi")) & (F.floor(F.col(f"to.{COL}") / block) == F.col("_bj"))
    return sent.where(own).select(*keys, "_bi", "_bj", F.col(f"to.{ROW}").alias(ROW), F.col(f"to.{COL}").alias(COL), F.col("to.centre").alias("centre"), *rest)


def focal(cells: DataFrame) -> DataFrame:
    """Maximum and mean over the 3 x 3 neighbourhood of each cell, cells with data only.

    Each cell is sent to the nine cells around it and summed there, block by
    block; there is no join of the raster with itself.
    """
    sent = _sent_around(cells.where("value is not null").select(ROW, COL, "value"))
    out = sent.groupBy("_bi", "_bj", ROW, COL).agg(F.max(F.when(F.col("centre"), F.col("value"))).alias("own"), F.max("value").alias("focal_max"), F.avg("value").alias("focal_mean"))
    return out.where("own is not null").select(ROW, COL, F.col("own").alias("value"), "focal_max", "focal_mean")


def edge_cells(lake: DataFrame, border: bool = True) -> DataFrame:
    """Cells of the lake with at least one of the eight neighbours outside it (``border``), or cells outside next to it."""
    near = _sent_around(lake.select(ROW, COL)).groupBy("_bi", "_bj", ROW, COL).agg(F.max(F.col("centre").cast("int")).alias("own"), F.count("*").alias("n"))
    return near.where("own = 1 and n < 9" if border else "own = 0").select(ROW, COL)


def lake_intersections(lake: DataFrame, streams: DataFrame, flow: DataFrame, n: int | None = None) -> DataFrame:
    """Stream cells on the lakes' outer edge: lake_id, outlet_id, cell_row, cell_col, subc_id, flow, flow_max, flow_mean.

    ``lake`` has lake_id and cells. Of a lake's cells with the same segment the
    one with the highest 3 x 3 flow maximum stays; outlets are numbered by mean
    flow, largest first (ties by segment).
    """
    from pyspark.sql import Window as W

    sent = _sent_around(lake.select("lake_id", ROW, COL), "lake_id")
    outer = sent.groupBy("lake_id", "_bi", "_bj", ROW, COL).agg(F.bool_or("centre").alias("own")).where("not own").select("lake_id", ROW, COL)
    around = focal(flow)
    hit = outer.join(streams.select(ROW, COL, F.col("value").alias("subc_id")), [ROW, COL]).join(around.select(ROW, COL, F.col("value").alias("flow"), F.col("focal_max").alias("flow_max"), F.col("focal_mean").alias("flow_mean")), [ROW, COL])
    one = hit.withColumn("_n", F.row_number().over(W.partitionBy("lake_id", "subc_id").orderBy(F.desc("flow_max"), F.desc("flow"), ROW, COL))).where("_n = 1").drop("_n")
    out = one.withColumn("outlet_id", F.row_number().over(W.partitionBy("lake_id").orderBy(F.desc("flow_mean"), "subc_id")))
    return out if n is None else out.where(F.col("outlet_id") <= n)


#: Eight directions as powers of two, clockwise from east, and their row and column steps.
D8 = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}


def cell_network(directions: DataFrame, width: int = 1 << 20):
    """The network of cells that a D8 direction raster makes; a cell's id is row * width + column."""
    from thalweg.operators.network import RiverNetwork

    step = lambda k: F.coalesce(reduce(lambda a, d: a.when(F.col("value") == d, D8[d][k]), list(D8)[1:], F.when(F.col("value") == 1, D8[1][k])), F.lit(0))
    to = (F.col(ROW) + step(0)) * width + F.col(COL) + step(1)
    id = F.col(ROW).cast("long") * width + F.col(COL)
    return RiverNetwork(directions.select(id.alias("id"), F.when(F.col("value").isin(*D8), to).otherwise(-1).alias("target")), "id", "target", None)


def upstream_cells(directions: DataFrame, outlets: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(outlet, cell_row, cell_col): the catchment mask of each outlet cell (cell_row, cell_col, outlet)."""
    from thalweg.operators.network import closure

    net = cell_network(directions, width)
    seeds = outlets.select("outlet", (F.col(ROW).cast("long") * width + F.col(COL)).alias("id"))
    pairs = closure(net, seeds=seeds)
    return pairs.join(seeds.withColumnRenamed("id", "base"), "base").select("outlet", F.expr(f"stream div {width}").alias(ROW), F.pmod("stream", F.lit(width)).alias(COL))


def area_by_value(cells: DataFrame, grid: Grid, radius: float = 6371.0088) -> DataFrame:
    """(value, km2): spherical cell areas summed by value."""
    top, bottom = F.radians(F.lit(grid.y0) - F.col(ROW) * grid.dy), F.radians(F.lit(grid.y0) - (F.col(ROW) + 1) * grid.dy)
    area = F.abs(F.sin(top) - F.sin(bottom)) * F.radians(F.lit(grid.dx)) * radius * radius
    return cells.where("value is not null").groupBy("value").agg(F.sum(area).alias("km2"))


def basin_polygon(cells: DataFrame, grid: Grid, basin: str = "value") -> DataFrame:
    """One row for each basin: cells, bounding box."""
    return cells.where(F.col(basin).isNotNull()).groupBy(basin).agg(F.count("*").alias("cells"), F.min(grid.lon(F.col(COL))).alias("xmin"), F.min(grid.lat(F.col(ROW))).alias("ymin"), F.max(grid.lon(F.col(COL))).alias("xmax"), F.max(grid.lat(F.col(ROW))).alias("ymax"))


def lake_catchments(intersections: DataFrame, directions: DataFrame, flow: str = "flow_max", lake: str = "lake_id", n: int | None = None, width: int = 1 << 20) -> DataFrame:
    """(lake, cell_row, cell_col): the cells that drain through a lake's ``n`` intersections of the largest flow (all without n).

    Equal flows go by row and column. A cell above several of them comes once.
    """
    from pyspark.sql import Window as W

    some = intersections
    if n is not None:
        some = some.withColumn("_k", F.row_number().over(W.partitionBy(lake).orderBy(F.desc(flow), ROW, COL))).where(F.col("_k") <= n)
    return upstream_cells(directions, some.select(F.col(lake).alias("outlet"), ROW, COL), width).withColumnRenamed("outlet", lake).distinct()
