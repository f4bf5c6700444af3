"""Polygons and lines as sides: rings from sides, union of touching polygons, scanline filling, buffers of cells, parts of lines.

A ring is an array of struct<x, y> without its first point again at the end.
Directed sides have the shape on their right, so outer rings run clockwise and
holes the other way. No ring travels with a cell or a point: sides do, to the
rows or buckets that they cross.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.operators.components import components
from thalweg.operators.crossing import crossed
from thalweg.operators.geometry import haversine
from thalweg.operators.grid import COL, ROW
from thalweg.plans.scratch import materialize, tasks_for

XY = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
_XY = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def sides_of(polygons: DataFrame, *keep: str) -> DataFrame:
    """(keep..., x1, y1, x2, y2): the sides of each ring, the last one back to the first point; sides without length are left out.

    Decimal coordinates stay decimals, so that their differences are exact; others are doubles.
    """
    exact = isinstance(polygons.schema["ring"].dataType.elementType["x"].dataType, T.DecimalType)
    number = lambda c: F.col(c) if exact else F.col(c).cast("double")
    turned = F.concat(F.slice("ring", F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    pairs = F.explode(F.arrays_zip(F.col("ring").alias("a"), turned.alias("b")))
    flat = polygons.where(F.size("ring") > 0).select(*keep, pairs.alias("_s")).select(*keep, *[number(f"_s.{p}.{c}").alias(f"{c}{k}") for k, p in ((1, "a"), (2, "b")) for c in ("x", "y")])
    return flat.where("x1 <> x2 or y1 <> y2")


def signed_area(ring: Column) -> Column:
    """Positive for rings that run counter-clockwise; each product is of the points around it, by built-in functions."""
    n = F.size(ring)
    at = lambda k: F.element_at(ring, k)
    step = lambda s, k: s + (at(k)["x"] * at(F.when(k < n, k + 1).otherwise(1))["y"] - at(F.when(k < n, k + 1).otherwise(1))["x"] * at(k)["y"]) / 2
    return F.when(n > 2, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), step)).otherwise(0.0)


# --- rings from sides ------------------------------------------------------------


def _whole_tiles(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 100_000) -> Iterator[pa.Table]:
    """The rows of batches that are sorted by ``keys`` in tables of about ``rows``, none of which ends within equal keys."""
    held, n, wait = [], 0, rows
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < wait:
            continue
        t = pa.Table.from_batches(held)
        last = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in keys])
        cut = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), n - cut
        wait = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def _follow(at: np.ndarray, to: np.ndarray, own: np.ndarray, here: np.ndarray, dx: np.ndarray, dy: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The row that follows each row whose end is ``here`` (else -1): of the ``own`` rows that begin there the one furthest to the right.

    That keeps rings that touch in a point apart. ``at`` and ``to`` number the points.
    """
    begin = np.flatnonzero(own)
    begin = begin[np.argsort(at[begin], kind="stable")]
    ends = np.flatnonzero(here)
    lo = np.searchsorted(at[begin], to[ends], "left")
    n = np.searchsorted(at[begin], to[ends], "right") - lo
    row = np.repeat(ends, n)
    after = begin[np.arange(len(row)) - np.repeat(np.cumsum(n) - n - lo, n)]
    turn = np.arctan2(dx[row] * dy[after] - dy[row] * dx[after] + 0.0, dx[row] * dx[after] + dy[row] * dy[after] + 0.0)
    best = np.lexsort((e[after], turn, row))
    best = best[np.r_[True, row[best][1:] != row[best][:-1]]] if len(best) else best
    out = np.full(len(at), -1)
    out[row[best]] = after[best]
    return out


def _runs(before: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows that each have at most one before them (-1: none): the first row of each one's run, the place in it, and whether it is closed.

    Closed runs begin at their row of the smallest rank. All by pointer doubling.
    """
    n = len(before)
    self_ = np.arange(n)
    back = np.where(before < 0, self_, before)
    least, jump = np.where(before < 0, -1, rank), back
    while (least != least[back]).any():
        least, jump = np.minimum(least, least[jump]), jump[jump]
    closed = least >= 0
    first = (before < 0) | (closed & (rank == least))
    jump = np.where(first, self_, back)
    place = (~first).astype(np.int64)
    while not first[jump].all():
        place, jump = place + place[jump], jump[jump]
    return jump, place, closed


def chain_rings(sides: DataFrame, tile: float = 1.0, simplify: bool = False) -> DataFrame:
    """(zone, ring): the closed rings of directed sides (zone, x1, y1, x2, y2), each from its smallest point on.

    Sides go once to the tile that they begin in and that they end in (``tile``
    in their unit), where each finds the side that follows it, many tiles at a
    time. A ring within a tile is done there; chains that leave a tile are told
    apart by the components of their links, and such a ring is put together from
    its chains; so a task holds some tiles of a zone, or one ring, which is one
    row of the result. ``simplify`` drops points at which a ring does not turn.
    Sides must close: at every point as many end as begin.
    """
    zone = sides.schema["zone"]
    place = lambda k: F.struct(F.floor(F.col(f"x{k}") / tile).alias("i"), F.floor(F.col(f"y{k}") / tile).alias("j"))
    tiles = F.when(place(1) == place(2), F.array(place(1))).otherwise(F.array(place(1), place(2)))
    side = ("x1", "y1", "x2", "y2")
    dealt = sides.where("zone is not null").select("zone", *side, F.explode(tiles).alias("_t")).select("zone", F.col("_t.i").alias("_i"), F.col("_t.j").alias("_j"), *side).repartition(tasks_for(sides), "zone", "_i", "_j")
    named = dealt.withColumn("_z", F.xxhash64("zone")).withColumn("e", F.xxhash64("zone", *side)).sortWithinPartitions("_z", "_i", "_j")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches, ("_z", "_i", "_j")):
            x1, y1, x2, y2, z, i, j, e = (t.column(c).to_numpy() for c in (*side, "_z", "_i", "_j", "e"))
            own = (np.floor(x1 / tile) == i) & (np.floor(y1 / tile) == j)
            here = (np.floor(x2 / tile) == i) & (np.floor(y2 / tile) == j)
            n = len(z)
            group = np.cumsum(np.r_[False, (z[1:] != z[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            g, x, y = np.r_[group, group], np.r_[x1, x2], np.r_[y1, y2]
            order = np.lexsort((y, x, g))
            g, x, y = g[order], x[order], y[order]
            point = np.empty(2 * n, np.int64)
            point[order] = np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            dx, dy = x2 - x1, y2 - y1
            next_ = _follow(point[:n], point[n:], own, here, dx, dy, e)
            before = np.full(n, -1)
            before[next_[next_ >= 0]] = np.flatnonzero(next_ >= 0)
            rank = np.empty(n, np.int64)
            rank[np.argsort(point[:n], kind="stable")] = np.arange(n)
            first, at, closed = _runs(before, rank)
            rows = np.flatnonzero(own)
            rows = rows[np.lexsort((at[rows], first[rows]))]
            if not len(rows):
                continue
            start = np.flatnonzero(np.r_[True, first[rows][1:] != first[rows][:-1]])
            last = np.r_[start[1:], len(rows)] - 1
            heads, ends, whole = first[rows[start]], rows[last], closed[rows[start]]
            size = last - start + 1
            if simplify:
                came = np.r_[0, rows[:-1]]
                came[start] = ends
                turns = (dx[came] * dy[rows] != dy[came] * dx[rows]) | (dx[came] * dx[rows] + dy[came] * dy[rows] < 0) | ~closed[rows]
                size = np.add.reduceat(turns.astype(np.int64), start)
                rows = rows[turns]
            xy = pa.StructArray.from_arrays([pa.array(x1[rows]), pa.array(y1[rows])], fields=list(_XY.value_type))
            points = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), xy, type=_XY)
            yield pa.record_batch([t.column("zone").combine_chunks().take(pa.array(heads)), pa.array(e[heads], mask=whole), pa.array(e[ends], mask=whole), points], names=["zone", "head", "after", "points"])

    schema = T.StructType([zone, T.StructField("head", T.LongType()), T.StructField("after", T.LongType()), T.StructField("points", XY)])
    found = materialize(named.mapInArrow(chain, schema), "chains")
    chains = found.where("head is not null")
    names = components(chains.select(F.col("head").alias("a"), F.col("after").alias("b")))
    whole = chains.join(names, chains["head"] == names["node"], "left").select("zone", F.coalesce("component", "head").alias("_ring"), F.struct("head", "after", "points").alias("c"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = []
            for found in batch.column("chains").to_pylist():
                to = {c["head"]: c for c in found}
                e, line = min(to), []
                while e in to:
                    c = to.pop(e)
                    e = c["after"]
                    line += [(p["x"], p["y"]) for p in c["points"]]
                rings.append(_tidy(np.array(line), simplify))
            yield pa.record_batch([batch.column("zone"), pa.array([[{"x": x, "y": y} for x, y in r.tolist()] for r in rings], _XY)], names=["zone", "ring"])

    over = whole.groupBy("zone", "_ring").agg(F.collect_list("c").alias("chains")).select("zone", "chains").mapInArrow(finish, T.StructType([zone, T.StructField("ring", XY)]))
    return found.where("head is null").select("zone", F.col("points").alias("ring")).unionByName(over)


def _tidy(ring: np.ndarray, simplify: bool) -> np.ndarray:
    """The ring from its smallest point on, without the points at which it goes straight on."""
    if simplify:
        a, b = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
        ring = ring[(a[:, 0] * b[:, 1] != a[:, 1] * b[:, 0]) | ((a * b).sum(axis=1) < 0)]
    return np.roll(ring, -int(np.lexsort((ring[:, 1], ring[:, 0]))[0]), axis=0)


def dissolve_polygons(polygons: DataFrame, id: str = "id", units: int = 1_000_000, bucket: float = 0.1, tile: float = 1.0) -> DataFrame:
    """(id, ring, hole): the union of each id's polygons (id, ring[, hole]), such as the parts of tiles that were cut along borders.

    Coordinates are taken in whole ``units`` of a degree, where all tests are
    exact. Sides are cut at the points of the same id that lie on them (met by
    buckets), sides that run both ways cancel, and what is left is chained.
    Polygons of one id may touch in any way and be given repeatedly; parts that
    lie over each other with different borders are not what tiles give, and are
    not cut against each other. Rings may run either way round; ``hole`` marks
    inner rings and is false where there is no such column. Shapes without an
    id, without area or without a ring are left out.
    """
    hole = F.coalesce(F.col("hole"), F.lit(False)) if "hole" in polygons.columns else F.lit(False)
    rows = polygons.where(F.col(id).isNotNull() & F.col("ring").isNotNull()).select(F.col(id).alias("zone"), hole.alias("_hole"), "ring").withColumn("_area", signed_area(F.col("ring"))).where("_area <> 0")
    whole = lambda c: F.round(F.col(c) * units).cast("long")
    flat = sides_of(rows, "zone", "_hole", "_area").select("zone", "_hole", "_area", *[whole(c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    turn = (F.col("_area") > 0) != F.col("_hole")  # outer rings clockwise, holes the other way
    way = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a)
    sides = materialize(flat.select("zone", way("x1", "x2"), way("y1", "y2"), F.when(turn, F.col("x1")).otherwise(F.col("x2")).alias("x2"), F.when(turn, F.col("y1")).otherwise(F.col("y2")).alias("y2")).where("x1 <> x2 or y1 <> y2"), "polygon-sides")
    size = max(1, round(bucket * units))
    deal = lambda p, q: F.explode(F.sequence(F.floor(F.least(p, q) / size), F.floor(F.greatest(p, q) / size)))
    points = sides.select("zone", F.col("x1").alias("x"), F.col("y1").alias("y")).distinct().select("zone", "x", "y", F.floor(F.col("x") / size).alias("_i"), F.floor(F.col("y") / size).alias("_j"))
    long = sides.distinct().withColumn("_i", deal("x1", "x2")).withColumn("_j", deal("y1", "y2"))
    d = lambda a, b: (F.col(a) - F.col(b)).cast("decimal(19,0)")
    on = (d("x2", "x1") * d("y", "y1") == d("y2", "y1") * d("x", "x1")) & F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    inside = on & ~((F.col("x") == F.col("x1")) & (F.col("y") == F.col("y1"))) & ~((F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")))
    along = F.struct((F.abs(F.col("x") - F.col("x1")) + F.abs(F.col("y") - F.col("y1"))).alias("t"), "x", "y")
    key = ["zone", "x1", "y1", "x2", "y2"]
    nodes = long.join(points, ["zone", "_i", "_j"]).where(inside).groupBy(*key).agg(F.array_sort(F.collect_set(along)).alias("nodes"))
    cut = sides.join(nodes, key, "left")
    line = F.concat(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))), F.coalesce(F.transform("nodes", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array().cast("array<struct<x: bigint, y: bigint>>")), F.array(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    pieces = cut.select("zone", line.alias("l")).select("zone", F.explode(F.arrays_zip(F.slice("l", F.lit(1), F.size("l") - 1).alias("a"), F.slice("l", F.lit(2), F.size("l") - 1).alias("b"))).alias("s")).select("zone", "s.a", "s.b")
    forward = F.when(F.col("a") < F.col("b"), 1).otherwise(-1)
    left = pieces.groupBy("zone", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.min(forward).alias("n"), F.max(forward).alias("m")).where("n = m")  # one way only, however often
    end = lambda p, q, c: F.when(F.col("n") > 0, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).cast("double")
    kept = left.select("zone", end("p", "q", "x").alias("x1"), end("p", "q", "y").alias("y1"), end("q", "p", "x").alias("x2"), end("q", "p", "y").alias("y2"))
    rings = chain_rings(kept, tile * units, simplify=True)
    out = rings.select(F.col("zone").alias(id), F.transform("ring", lambda p: F.struct((p["x"] / units).alias("x"), (p["y"] / units).alias("y"))).alias("ring"))
    return out.withColumn("hole", signed_area(F.col("ring")) > 0)


# --- filling ---------------------------------------------------------------------


def spans(polygons: DataFrame, grid, poly: str = "poly_id", touched: bool | str = False) -> DataFrame:
    """(poly, cell_row, first, last): runs of columns whose centres lie in a polygon, row by row.

    A polygon's rings are all rows with its id; the even-odd rule makes inner
    ones holes. Every side goes to the rows whose centre line it crosses, a
    row's crossings are sorted, and each second gap between them is filled.
    With ``touched`` the cells that a side comes to count as well (runs may then
    meet or overlap), with ``touched="through"`` only those that hold a stretch
    of a side, not a corner or an end alone.
    """
    sides = sides_of(polygons.where(F.col(poly).isNotNull() & F.col("ring").isNotNull()), poly)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    top = lambda y: (F.lit(grid.y0) - y) / F.lit(grid.dy)
    more = int(touched == "through")  # rows beside it, which the sides' own test drops
    rows = F.sequence(F.floor(top(high)).cast("long") - more, F.floor(top(low)).cast("long") + more)
    dealt = sides.withColumn(ROW, F.explode(rows))
    y = grid.lat(F.col(ROW))
    crossed = dealt.where((F.col("y1") > y) != (F.col("y2") > y)).select(poly, ROW, ((F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"))
    sorted_ = crossed.groupBy(poly, ROW).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    gaps = sorted_.select(poly, ROW, F.explode(F.transform(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2)), lambda k: F.struct(F.element_at("xs", k).alias("a"), F.element_at("xs", k + 1).alias("b")))).alias("g"))
    # the first column whose centre is at or beyond x; the estimate is put right by the centre itself
    def column(x: Column) -> Column:
        c = F.ceil((x - F.lit(grid.x0)) / F.lit(grid.dx) - 0.5).cast("long")
        return F.when(grid.lon(c - 1) >= x, c - 1).when(grid.lon(c) < x, c + 1).otherwise(c)

    runs = gaps.select(poly, ROW, column(F.col("g.a")).alias("first"), (column(F.col("g.b")) - 1).alias("last")).where("first <= last")
    if not touched:
        return runs
    # of each side the part within the row's band
    edge = lambda k: F.lit(grid.y0) - (F.col(ROW) + k) * F.lit(grid.dy)
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    flat = F.col("y1") == F.col("y2")
    xa = F.when(flat, F.col("x1")).otherwise(at(F.greatest(low, F.least(high, edge(1)))))
    xb = F.when(flat, F.col("x2")).otherwise(at(F.greatest(low, F.least(high, edge(0)))))
    near = dealt.select(poly, ROW, "x1", "y1", "x2", "y2", grid.col(F.least(xa, xb)).cast("long").alias("_a"), grid.col(F.greatest(xa, xb)).cast("long").alias("_b"))

    if touched != "through":
        return runs.unionByName(near.select(poly, ROW, F.col("_a").alias("first"), F.col("_b").alias("last")))

    def part(v1: str, v2: str, lo: Column, hi: Column) -> tuple[Column, Column]:
        """Where along the side it comes into a band and leaves it; 2 where it never does."""
        d = F.col(v2) - F.col(v1)
        ends = (F.try_divide(lo - F.col(v1), d), F.try_divide(hi - F.col(v1), d))
        level = F.col(v1) == F.col(v2)
        return F.when(level, F.when((F.col(v1) >= lo) & (F.col(v1) < hi), 0.0).otherwise(2.0)).otherwise(F.least(*ends)), F.when(level, 1.0).otherwise(F.greatest(*ends))

    def runs_through(c: Column) -> Column:
        x = part("x1", "x2", F.lit(grid.x0) + c * F.lit(grid.dx), F.lit(grid.x0) + (c + 1) * F.lit(grid.dx))
        y = part("y1", "y2", edge(1), edge(0))
        return F.greatest(F.lit(0.0), x[0], y[0]) < F.least(F.lit(1.0), x[1], y[1])

    # a cell counts if a stretch of the side lies in it, not for a corner or an end alone; only a run's ends are in doubt
    whole = F.sequence(F.col("_a") - 1, F.col("_b") + 1)
    ends = F.when(F.col("_b") - F.col("_a") <= 3, whole).otherwise(F.concat(F.sequence(F.col("_a") - 1, F.col("_a") + 1), F.sequence(F.col("_b") - 1, F.col("_b") + 1)))
    sure = near.where("_b - _a > 3").select(poly, ROW, (F.col("_a") + 2).alias("first"), (F.col("_b") - 2).alias("last"))
    tried = near.withColumn("_c", F.explode(ends)).where(runs_through(F.col("_c"))).select(poly, ROW, F.col("_c").alias("first"), F.col("_c").alias("last"))
    hit = sure.unionByName(tried).distinct()
    return runs.unionByName(hit)


def cells_in_spans(runs: DataFrame, cells: DataFrame, poly: str = "poly_id", block: int = 256) -> DataFrame:
    """(poly, cell_row, cell_col) of the cells that runs cover, each once; runs meet cells by row and block of columns."""
    dealt = runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))))
    c = cells.select(ROW, COL).distinct().withColumn("_b", F.floor(F.col(COL) / block))
    met = c.join(dealt, [ROW, "_b"]).where(F.col(COL).between(F.col("first"), F.col("last")))
    return met.select(poly, ROW, COL).distinct()


def fill(polygons: DataFrame, grid, poly: str = "poly_id", touched: bool | str = False) -> DataFrame:
    """(poly, cell_row, cell_col): all cells of the grid in each polygon."""
    return spans(polygons, grid, poly, touched).select(poly, ROW, F.explode(F.sequence("first", "last")).alias(COL)).distinct()


def inside(points: DataFrame, polygons: DataFrame, size: float = 1.0, id: str = "id", poly: str = "poly_id", strips: int = 16, border: bool | None = None) -> DataFrame:
    """(id, poly_id): points (id, lon, lat) inside polygons, by the even-odd rule over all rings of an id.

    Points meet the boxes of polygons by buckets of ``size`` degrees; what meets
    the points then is not the ring but the sides in the same strip of latitude,
    ``strips`` of them a bucket. Points of one place and polygons of equal rings
    are judged once; the result's rows are their joins with what was found. With
    ``border`` false points on a side are outside, with true inside; without it
    the even-odd rule decides (left and lower sides are in).
    """
    rings = polygons.where(F.col(poly).isNotNull() & F.col("ring").isNotNull() & (F.size("ring") > 2)).select(poly, "ring")
    shape = rings.groupBy(poly).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2(F.col("ring").cast("string"), 256))), ","), 256).alias("_shape"))
    alike = shape.select(poly, F.min(poly).over(W.partitionBy("_shape")).alias("_like")).hint("merge")
    good = rings.join(alike.where(F.col(poly) == F.col("_like")).select(poly), poly, "left_semi")
    box = good.groupBy(poly).agg(F.min(F.array_min("ring.x")).alias("x0"), F.max(F.array_max("ring.x")).alias("x1"), F.min(F.array_min("ring.y")).alias("y0"), F.max(F.array_max("ring.y")).alias("y1"))
    bucket = lambda c: F.floor(c / size)
    dealt = box.withColumn("bx", F.explode(F.sequence(bucket(F.col("x0")), bucket(F.col("x1"))))).withColumn("by", F.explode(F.sequence(bucket(F.col("y0")), bucket(F.col("y1")))))
    at = points.where("lon is not null and lat is not null").select(F.col(id).alias("_id"), "lon", "lat")
    p = at.select("lon", "lat").distinct().select("lon", "lat", bucket(F.col("lon")).alias("bx"), bucket(F.col("lat")).alias("by"))
    near = p.join(dealt, ["bx", "by"]).where(F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))).select(poly, "lon", "lat", F.floor(F.col("lat") * (strips / size)).alias("_s"))
    strip = lambda c: F.floor(c * (strips / size))
    sides = (sides_of(good, poly) if border is not None else sides_of(good, poly).where("y1 <> y2")).withColumn("_s", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))))
    straddles = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    right = F.when(straddles, F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).otherwise(False)
    within = lambda v, a, b: F.col(v).between(F.least(a, b), F.greatest(a, b))
    on = within("lon", "x1", "x2") & within("lat", "y1", "y2") & ((F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) == (F.col("y2") - F.col("y1")) * (F.col("lon") - F.col("x1")))
    met = near.join(sides, [poly, "_s"]).where(right if border is None else right | on)
    odd = F.count_if(right) % 2 == 1
    judged = met.groupBy(poly, "lon", "lat").agg((odd if border is None else F.bool_or(on) | odd if border else ~F.bool_or(on) & odd).alias("_in")).where("_in")
    held = judged.select(F.col(poly).alias("_like"), "lon", "lat").hint("merge").join(at, ["lon", "lat"]).select("_id", "_like")
    return crossed(alike, held, "_like", "_id").select(F.col("_id").alias(id), poly)


def met_by_box(polygons: DataFrame, box: tuple[float, float, float, float], poly: str = "poly_id") -> DataFrame:
    """(poly): the polygons that a box (xmin, ymin, xmax, ymax) meets, its sides included.

    A side runs through the box, or the box lies inside altogether, which its
    first corner tells (even-odd rule). One pass over the sides.
    """
    xmin, ymin, xmax, ymax = map(float, box)
    s = sides_of(polygons.where(F.col(poly).isNotNull() & F.col("ring").isNotNull()), poly)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    low, high, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for p, q in ((-dx, F.col("x1") - xmin), (dx, xmax - F.col("x1")), (-dy, F.col("y1") - ymin), (dy, ymax - F.col("y1"))):
        out = out | ((p == 0) & (q < 0))
        low.append(F.when(p < 0, F.try_divide(q, p)))
        high.append(F.when(p > 0, F.try_divide(q, p)))
    through = ~out & (F.greatest(*low) <= F.least(*high))  # nulls do not count in either
    crossed = ((F.col("y1") > ymin) != (F.col("y2") > ymin)) & (xmin < F.try_divide(dx * (ymin - F.col("y1")), dy) + F.col("x1"))
    met = s.groupBy(poly).agg(F.bool_or(through).alias("_t"), F.count_if(crossed).alias("_n"))
    return met.where("_t or _n % 2 = 1").select(poly)


def lake_ids(lakes: DataFrame, points: DataFrame, box: tuple[float, float, float, float] | bool = False, id: str = "lake_id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Ids of the lakes (id, ring) that hold a point, or, with ``box``, of those that it meets; True is the points' own extent."""
    if box is False:
        at = points.select(F.col(lon).alias("lon"), F.col(lat).alias("lat")).distinct().withColumn("_at", F.struct("lon", "lat"))
        return inside(at, lakes, id="_at", poly=id).select(id).distinct()
    if box is True:
        r = points.agg(*[f(c).cast("double") for f, c in ((F.min, lon), (F.min, lat), (F.max, lon), (F.max, lat))]).first()
        if r[0] is None or r[1] is None:
            return lakes.select(id).limit(0)
        box = tuple(r)
    return met_by_box(lakes, box, id)


# --- buffers of cells ----------------------------------------------------------------


def buffer_width(km2: Column) -> Column:
    """Width in degrees of a lake's buffer by its area in square kilometres (fixed values)."""
    return F.when(km2 <= 1, 0.0009).when(km2 <= 50, 0.0018).when(km2 <= 100, 0.0027).otherwise(0.0036)


def buffer_cells(lakes: DataFrame, radius: Column | float, id: str = "lake_id", block: int = 256) -> DataFrame:
    """(id, cell_row, cell_col, d2): cells within ``radius`` cells of each lake's cells, with the squared distance to the nearest.

    ``radius`` is a number or a column of ``lakes``, one value for each lake.
    The exact transform in two steps, first along columns, then along rows,
    both from the ends of runs only: a cell sends its distance on to one side
    only if the next cell there is further from the lake than itself, so what is
    sent grows with the outline times the radius, and no two cells are paired.
    A lake's cells go to their block of ``block`` cells and to those that their
    squares of the radius reach; both steps run within a block, so only the
    lakes' own cells are shuffled, and a block gives its own cells.
    """
    r = F.lit(float(radius)) if isinstance(radius, int | float) else radius
    own = lakes.where(F.col(id).isNotNull()).select(id, F.col(ROW).cast("long").alias(ROW), F.col(COL).cast("long").alias(COL), r.cast("double").alias("_r")).where("_r >= 0")
    reach = F.floor("_r").cast("long")
    every = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / block), F.floor((F.col(c) + reach) / block)))
    place = [id, "_i", "_j"]
    dealt = own.withColumn("_i", every(ROW)).withColumn("_j", every(COL)).repartition(tasks_for(lakes, 1.0), *place).distinct()
    down = W.partitionBy(*place, COL).orderBy(ROW)
    gap = lambda c, w, step, n=1: F.coalesce(F.abs(F.lead(c, n).over(w) - F.col(c)) != 1, F.lit(True)) if step > 0 else F.coalesce(F.abs(F.col(c) - F.lag(c, n).over(w)) != 1, F.lit(True))
    ends = dealt.withColumn("_last", gap(ROW, down, 1)).withColumn("_first", gap(ROW, down, -1))
    within = lambda c, b: F.floor(c / block) == F.col(b)
    up = F.when(F.col("_first") & (reach > 0), F.sequence(-reach, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    below = F.when(F.col("_last") & (reach > 0), F.sequence(F.lit(1).cast("long"), reach)).otherwise(F.array().cast("array<bigint>"))
    tall = ends.select(*place, COL, "_r", F.col(ROW).alias("_from"), F.explode(F.concat(F.array(F.lit(0).cast("long")), up, below)).alias("_k")).where(within(F.col("_from") + F.col("_k"), "_i"))
    first = tall.groupBy(*place, (F.col("_from") + F.col("_k")).alias(ROW), COL).agg(F.min(F.abs("_k")).alias("g"), F.max("_r").alias("_r"))
    across = W.partitionBy(*place, ROW).orderBy(COL)
    lower = lambda step: F.coalesce((F.abs((F.lead(COL) if step > 0 else F.lag(COL)).over(across) - F.col(COL)) != 1) | ((F.lead("g") if step > 0 else F.lag("g")).over(across) > F.col("g")), F.lit(True))
    wide = first.withColumn("_right", lower(1)).withColumn("_left", lower(-1)).withColumn("_h", F.floor(F.sqrt(F.col("_r") * F.col("_r") - F.col("g") * F.col("g"))).cast("long"))
    west = F.when(F.col("_left") & (F.col("_h") > 0), F.sequence(-F.col("_h"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    east = F.when(F.col("_right") & (F.col("_h") > 0), F.sequence(F.lit(1).cast("long"), F.col("_h"))).otherwise(F.array().cast("array<bigint>"))
    sent = wide.select(*place, ROW, F.col(COL).alias("_from"), "g", F.explode(F.concat(F.array(F.lit(0).cast("long")), west, east)).alias("_k")).where(within(F.col("_from") + F.col("_k"), "_j"))
    met = sent.groupBy(*place, ROW, (F.col("_from") + F.col("_k")).alias(COL)).agg(F.min(F.col("g") * F.col("g") + F.col("_k") * F.col("_k")).alias("d2"))
    return met.select(id, ROW, COL, "d2")


# --- parts of lines ---------------------------------------------------------------------


def cut_lines(lines: DataFrame, parts: DataFrame, id: str = "subc_id", part: str = "id", geom: str = "geom", planar: bool = False) -> DataFrame:
    """``parts`` (part, fraction_start, fraction_end, ...) with geom: the stretch of the line between the two fractions of its length.

    Lengths are great-circle ones, or those of the plane. A part without length
    is a line of two equal points; fractions outside [0, 1] or in the wrong
    order, and lines of fewer than two points or without length, give no row.
    Built-in functions only, no shuffle but the join by id.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.size(geom) - 1), lambda k: F.struct(F.element_at(geom, k).alias("a"), F.element_at(geom, k + 1).alias("b")))
    length = lambda p: F.sqrt(F.pow(p["a"]["x"] - p["b"]["x"], 2) + F.pow(p["a"]["y"] - p["b"]["y"], 2)) if planar else haversine(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"])
    # the measure of each point: running sums of the lengths between them
    measure = lambda: F.aggregate("_lens", F.array(F.lit(0.0)), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v)))
    measured = lines.where(F.size(geom) > 1).select(F.col(id).alias("_id"), F.col(geom).alias("_g"), F.transform(pairs, length).alias("_lens")).withColumn("_m", measure()).where(F.element_at("_m", -1) > 0).drop("_lens")
    met = parts.where("0 <= fraction_start and fraction_start <= fraction_end and fraction_end <= 1").join(measured, F.col(part) == F.col("_id"))
    total = F.element_at("_m", -1)
    lo, hi = F.col("fraction_start") * total, F.col("fraction_end") * total
    n = F.size("_m")

    def at(v: Column) -> Column:
        """The point at a measure: the last piece that begins at or before it."""
        k = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter("_m", lambda m: m <= v))))
        m0, m1, p, q = F.element_at("_m", k), F.element_at("_m", k + 1), F.element_at("_g", k), F.element_at("_g", k + 1)
        t = F.when(m1 > m0, (v - m0) / (m1 - m0)).otherwise(0.0)
        return F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))

    between = F.filter(F.arrays_zip(F.col("_m").alias("m"), F.col("_g").alias("p")), lambda z: (z["m"] > lo) & (z["m"] < hi))
    middle = F.transform(between, lambda z: F.struct(z["p"]["x"].cast("double").alias("x"), z["p"]["y"].cast("double").alias("y")))
    return met.select(*[c for c in parts.columns if c != geom], F.concat(F.array(at(lo)), middle, F.array(at(hi))).alias(geom))
