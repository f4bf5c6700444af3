"""Registered queries over polygons, buffers and parts of lines, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators import cleaning as CL
from thalweg.operators import geometry as GEO
from thalweg.operators import grid as G
from thalweg.operators import habitat as H
from thalweg.operators import network as N
from thalweg.operators import projection as P
from thalweg.operators import shapes as S
from thalweg.plans.fixtures import sql, table, view
from thalweg.plans.more_queries import SQL as MORE_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, *views)
        return f

    return add


# --- rings -------------------------------------------------------------------------


def _rings_sql(squares: str, of: str = "z") -> str:
    """Rings of the unions of unit squares (z, x, y), walked side by side from their smallest corner."""
    return f"""WITH RECURSIVE q AS ({squares}),
s AS (SELECT z, x AS x1, y AS y1, x AS x2, y + 1 AS y2 FROM q UNION ALL SELECT z, x, y + 1, x + 1, y + 1 FROM q UNION ALL SELECT z, x + 1, y + 1, x + 1, y FROM q UNION ALL SELECT z, x + 1, y, x, y FROM q),
k AS (SELECT a.* FROM s a LEFT JOIN s b ON a.z = b.z AND a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1 WHERE b.z IS NULL),
u AS (SELECT a.*, b.x2 AS nx, b.y2 AS ny, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS turn FROM k a JOIN k b ON a.z = b.z AND b.x1 = a.x2 AND b.y1 = a.y2),
n AS (SELECT z, x1, y1, x2, y2, min_by(nx, turn) AS nx, min_by(ny, turn) AS ny, min(turn) AS turn FROM u GROUP BY z, x1, y1, x2, y2),
t AS (SELECT z, x1 AS sx, y1 AS sy, x1 AS px, y1 AS py, x2 AS x, y2 AS y, x1 < x2 AS hole, CAST(x1 AS VARCHAR) || ' ' || CAST(y1 AS VARCHAR) AS ring FROM k WHERE x2 > x1 OR y2 > y1
UNION ALL SELECT t.z, sx, sy, t.x, t.y, n.nx, n.ny, hole, CASE WHEN n.turn = 0 THEN ring ELSE ring || ',' || CAST(t.x AS VARCHAR) || ' ' || CAST(t.y AS VARCHAR) END
FROM t JOIN n ON n.z = t.z AND n.x1 = t.px AND n.y1 = t.py AND n.x2 = t.x AND n.y2 = t.y WHERE (t.x <> sx OR t.y <> sy) AND (n.nx > sx OR (n.nx = sx AND n.ny >= sy)))
SELECT z AS {of}, hole, ring FROM t WHERE x = sx AND y = sy"""


def _text(ring) -> F.Column:
    number = lambda c: F.round(c).cast("long").cast("string")
    return F.array_join(F.transform(ring, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))), ",")


_SQUARES = "SELECT c_nationkey % 4 AS z, c_custkey % 40 AS x, c_custkey // 40 AS y FROM customer"


def tile_parts(customers: DataFrame) -> DataFrame:
    """(id, ring): squares 40 a row as tiles deliver shapes: whole, in halves of either kind, or repeated."""
    c = customers.select((F.col("c_nationkey") % 4).alias("id"), (F.col("c_custkey") % 40).cast("double").alias("x"), F.floor(F.col("c_custkey") / 40).cast("double").alias("y"), (F.col("c_custkey") % 7).alias("kind"))
    box = lambda x0, y0, x1, y1: F.struct(*[(F.col("x") + v).alias(n) for n, v in (("x0", x0), ("x1", x1))], *[(F.col("y") + v).alias(n) for n, v in (("y0", y0), ("y1", y1))])
    whole = F.array(box(0, 0, 1, 1))
    boxes = F.when(F.col("kind").isin(0, 3), F.array(box(0, 0, 0.5, 1), box(0.5, 0, 1, 1))).when(F.col("kind").isin(1, 5), F.array(box(0, 0, 1, 0.25), box(0, 0.25, 1, 1))).when(F.col("kind") == 2, F.concat(whole, whole)).otherwise(whole)
    corner = lambda x, y: F.struct(F.col(f"b.{x}").alias("x"), F.col(f"b.{y}").alias("y"))
    # every second part runs the other way round
    ring = F.array(corner("x0", "y0"), corner("x0", "y1"), corner("x1", "y1"), corner("x1", "y0"))
    return c.select("id", "kind", F.explode(boxes).alias("b")).select("id", F.when(F.col("kind") % 2 == 0, F.reverse(ring)).otherwise(ring).alias("ring"))


@query(_rings_sql(_SQUARES, "id"))
def a6_dissolved_rings(spark: SparkSession, sf: str) -> DataFrame:
    rings = S.dissolve_polygons(tile_parts(table(spark, sf, "customer")), tile=8.0)
    return rings.select("id", "hole", _text("ring").alias("ring"))


@query("SELECT c_nationkey % 4 AS id, CAST(count(*) AS DOUBLE) AS area FROM customer GROUP BY 1")
def k7_merged_tile_areas(spark: SparkSession, sf: str) -> DataFrame:
    rings = S.dissolve_polygons(tile_parts(table(spark, sf, "customer")), tile=4.0)
    return rings.groupBy("id").agg(F.round(-F.sum(S.signed_area(F.col("ring"))), 6).alias("area"))


@query(_rings_sql("SELECT DISTINCT zone AS z, cell_col AS x, -1 - cell_row AS y FROM cells", "zone"), "cells")
def x6_basin_rings(spark: SparkSession, sf: str) -> DataFrame:
    sides = GEO.cell_outlines(view(spark, sf, "cells"), G.Grid(0.0, 0.0, 1.0, 1.0), "zone")
    rings = S.chain_rings(sides, 256.0, simplify=True)
    return rings.select("zone", (S.signed_area(F.col("ring")) > 0).alias("hole"), _text("ring").alias("ring"))


# --- filling -----------------------------------------------------------------------

# a concave shape and a hole in it, moved and stretched by the supplier
_OUTER = ((0.13, 0.21), (4.07, 3.05), (8.11, 0.17), (6.03, 6.09), (9.02, 7.01), (3.04, 8.03), (4.01, 4.06), (1.02, 5.07))
_HOLE = ((4.51, 4.52), (5.53, 4.03), (5.04, 6.55))
_GRID = G.Grid(0.0, 60.0, 0.5, 0.25)
_SHAPED = f"""p AS (SELECT s_suppkey AS poly_id, s_suppkey % 13 * 3.01 AS ox, s_suppkey % 11 * 2.03 AS oy, 1 + s_suppkey % 3 * 0.37 AS k FROM supplier),
e AS (SELECT poly_id, ox + k * a AS x1, oy + k * b AS y1, ox + k * c AS x2, oy + k * d AS y2 FROM p, (VALUES {', '.join(f'({r[i][0]}, {r[i][1]}, {r[(i + 1) % len(r)][0]}, {r[(i + 1) % len(r)][1]})' for r in (_OUTER, _HOLE) for i in range(len(r)))}) v(a, b, c, d)),
g AS (SELECT poly_id, CAST(r AS BIGINT) AS cell_row, CAST(c AS BIGINT) AS cell_col, 60.0::DOUBLE - (r + 0.5) * 0.25::DOUBLE AS y, (c + 0.5) * 0.5::DOUBLE AS x FROM p, range(CAST(floor((60 - oy - k * 8.2) * 4) AS INT) - 1, CAST(floor((60 - oy) * 4) AS INT) + 2) a(r), range(CAST(floor(ox * 2) AS INT) - 1, CAST(floor((ox + k * 9.1) * 2) AS INT) + 2) b(c)),
f AS (SELECT g.poly_id, cell_row, cell_col, g.x, g.y, count(*) FILTER ((y1 > g.y) <> (y2 > g.y) AND g.x < (x2 - x1) * (g.y - y1) / (y2 - y1) + x1) AS n,
  bool_or(greatest(0, CASE WHEN x1 = x2 THEN CASE WHEN x1 >= g.x - 0.25 AND x1 < g.x + 0.25 THEN 0 ELSE 2 END ELSE least((g.x - 0.25 - x1) / (x2 - x1), (g.x + 0.25 - x1) / (x2 - x1)) END, least((g.y - 0.125 - y1) / (y2 - y1), (g.y + 0.125 - y1) / (y2 - y1)))
    < least(1, CASE WHEN x1 = x2 THEN 1 ELSE greatest((g.x - 0.25 - x1) / (x2 - x1), (g.x + 0.25 - x1) / (x2 - x1)) END, greatest((g.y - 0.125 - y1) / (y2 - y1), (g.y + 0.125 - y1) / (y2 - y1)))) AS hit
  FROM g JOIN e USING (poly_id) GROUP BY 1, 2, 3, 4, 5)"""


def _shaped(spark: SparkSession, sf: str) -> DataFrame:
    # decimals, as the SQL's literals are
    n = lambda v: F.lit(f"{v:.2f}").cast("decimal(4,2)")
    key = lambda m: (F.col("s_suppkey") % m).cast("decimal(2,0)")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("poly_id"), (key(13) * n(3.01)).alias("ox"), (key(11) * n(2.03)).alias("oy"), (1 + key(3) * n(0.37)).alias("k"))
    ring = lambda points: F.array(*[F.struct((F.col("ox") + F.col("k") * n(x)).cast("decimal(12,4)").alias("x"), (F.col("oy") + F.col("k") * n(y)).cast("decimal(12,4)").alias("y")) for x, y in points])
    return s.select("poly_id", F.explode(F.array(ring(_OUTER), ring(_HOLE))).alias("ring"))


@query(f"WITH {_SHAPED} SELECT poly_id, cell_row, cell_col FROM f WHERE n % 2 = 1")
def k16_filled_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return S.fill(_shaped(spark, sf), _GRID)


@query(f"WITH {_SHAPED} SELECT poly_id, cell_row, cell_col FROM f WHERE n % 2 = 1 OR hit")
def k16_touched_cells(spark: SparkSession, sf: str) -> DataFrame:
    return S.fill(_shaped(spark, sf), _GRID, touched="through")


@query(
    f"WITH {_SHAPED.split('g AS (')[0].rstrip().rstrip(',')}, o AS (SELECT c_custkey AS id, (c_custkey * 37 % 4000) / 100.0 AS lon, (c_custkey * 53 % 3000) / 100.0 AS lat FROM customer)"
    " SELECT id, poly_id FROM o, e WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, poly_id HAVING count(*) % 2 = 1"
)
def j18_points_in_shapes(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37 % 4000) / 100.0).alias("lon"), ((F.col("c_custkey") * 53 % 3000) / 100.0).alias("lat"))
    return GEO.points_in_polygons(points, _shaped(spark, sf), 4.0)


_EDGES = _SHAPED.split("g AS (")[0].rstrip().rstrip(",")
_BOX = (11.3, 9.7, 12.9, 14.2)
_CORNERS = [(_BOX[0], _BOX[1]), (_BOX[2], _BOX[1]), (_BOX[2], _BOX[3]), (_BOX[0], _BOX[3])]
_BORDER = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(_CORNERS, [*_CORNERS[1:], _CORNERS[0]], strict=True))


@query(
    f"WITH {_EDGES}, o AS (SELECT (c_custkey * 37 % 4000) / 100.0 AS lon, (c_custkey * 53 % 3000) / 100.0 AS lat FROM customer), m AS (SELECT lon, lat, poly_id FROM o, e WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY lon, lat, poly_id HAVING count(*) % 2 = 1) SELECT DISTINCT poly_id AS lake_id FROM m"
)
def k15_lakes_of_points(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "customer").select(((F.col("c_custkey") * 37 % 4000) / 100.0).alias("lon"), ((F.col("c_custkey") * 53 % 3000) / 100.0).alias("lat"))
    return S.lake_ids(_shaped(spark, sf).withColumnRenamed("poly_id", "lake_id"), points)


@query(
    f"WITH {_EDGES}, b AS (SELECT * FROM (VALUES {_BORDER}) v(bx1, by1, bx2, by2)), t AS (SELECT poly_id, (bx2 - bx1) * (y1 - by1) - (by2 - by1) * (x1 - bx1) AS o1, (bx2 - bx1) * (y2 - by1) - (by2 - by1) * (x2 - bx1) AS o2, (x2 - x1) * (by1 - y1) - (y2 - y1) * (bx1 - x1) AS o3, (x2 - x1) * (by2 - y1) - (y2 - y1) * (bx2 - x1) AS o4 FROM e, b)"
    f" SELECT DISTINCT poly_id AS lake_id FROM t WHERE o1 * o2 < 0 AND o3 * o4 < 0 UNION SELECT poly_id FROM e WHERE x1 BETWEEN {_BOX[0]} AND {_BOX[2]} AND y1 BETWEEN {_BOX[1]} AND {_BOX[3]}"
    f" UNION SELECT poly_id FROM e WHERE (y1 > {_BOX[1]}) <> (y2 > {_BOX[1]}) AND {_BOX[0]} < (x2 - x1) * ({_BOX[1]} - y1) / (y2 - y1) + x1 GROUP BY poly_id HAVING count(*) % 2 = 1"
)
def k15_lakes_met_by_box(spark: SparkSession, sf: str) -> DataFrame:
    lakes = _shaped(spark, sf).withColumnRenamed("poly_id", "lake_id")
    return S.lake_ids(lakes, lakes.limit(0), _BOX)


@query(
    "WITH l AS (SELECT DISTINCT zone AS lake_id, cell_row, cell_col, 1.5 + zone % 3 AS r FROM cells), o AS (SELECT a.i, b.i AS j FROM range(-3, 4) a(i), range(-3, 4) b(i))"
    " SELECT lake_id, CAST(cell_row + i AS BIGINT) AS cell_row, CAST(cell_col + j AS BIGINT) AS cell_col, CAST(min(i * i + j * j) AS BIGINT) AS d2 FROM l JOIN o ON i * i + j * j <= r * r GROUP BY 1, 2, 3",
    "cells",
)
def k16_lake_buffers(spark: SparkSession, sf: str) -> DataFrame:
    # every zone of the raster is a lake; wider ones have wider buffers
    lakes = view(spark, sf, "cells").select(F.col("zone").alias("lake_id"), "cell_row", "cell_col")
    return S.buffer_cells(lakes, 1.5 + F.col("lake_id") % 3)


# --- parts of lines -------------------------------------------------------------------

_STARTS = "SELECT site_id, subc_id, (site_id % 5) / 5.0 AS f FROM dams"
_CUT = f"""WITH RECURSIVE d(start, id, fs, rest) AS (SELECT site_id, s.subc_id, f::DOUBLE, 7000.0::DOUBLE FROM ({_STARTS}) s JOIN net USING (subc_id) UNION ALL SELECT start, n.target, 0.0, rest - n.length * (1 - fs) FROM d JOIN net n ON n.subc_id = d.id WHERE n.target >= 0 AND rest - n.length * (1 - fs) > 0),
u(start, id, fe, rest) AS (SELECT site_id, s.subc_id, f::DOUBLE, 5000.0::DOUBLE FROM ({_STARTS}) s JOIN net USING (subc_id) UNION ALL SELECT start, n.subc_id, 1.0, rest - m.length * fe FROM u JOIN net m ON m.subc_id = u.id JOIN net n ON n.target = u.id WHERE rest - m.length * fe > 0),
w AS (SELECT start, id, fs, least(1, fs + rest / length) AS fe FROM d JOIN net ON subc_id = id UNION ALL SELECT start, id, greatest(0, fe - rest / length), fe FROM u JOIN net ON subc_id = id),
p AS (SELECT start, id, min(fs) AS fs, max(fe) AS fe FROM w GROUP BY start, id),
l AS (SELECT subc_id, subc_id % 40 + 0.0 AS xa, subc_id // 40 + 0.0 AS ya, CASE WHEN target < 0 THEN 41.0 ELSE target % 40 END AS xc, CASE WHEN target < 0 THEN 0.0 ELSE target // 40 END AS yc FROM net),
b AS (SELECT *, xa + 0.3 AS xb, ya + 0.7 AS yb, sqrt(0.58) AS l1, sqrt(pow(xc - xa - 0.3, 2) + pow(yc - ya - 0.7, 2)) AS l2 FROM l),
m AS (SELECT start, id, fs, fe, b.*, fs * (l1 + l2) AS lo, fe * (l1 + l2) AS hi FROM p JOIN b ON subc_id = id)
SELECT start, id AS subc_id, round(CASE WHEN lo < l1 THEN xa + lo / l1 * 0.3 ELSE xb + (lo - l1) / l2 * (xc - xb) END, 6) + 0.0 AS x1, round(CASE WHEN lo < l1 THEN ya + lo / l1 * 0.7 ELSE yb + (lo - l1) / l2 * (yc - yb) END, 6) + 0.0 AS y1,
round(CASE WHEN hi < l1 THEN xa + hi / l1 * 0.3 ELSE xb + (hi - l1) / l2 * (xc - xb) END, 6) + 0.0 AS x2, round(CASE WHEN hi < l1 THEN ya + hi / l1 * 0.7 ELSE yb + (hi - l1) / l2 * (yc - yb) END, 6) + 0.0 AS y2,
CASE WHEN lo < l1 AND l1 < hi THEN 3 ELSE 2 END AS n_points, round(fe - fs, 6) AS share FROM m"""


def bent_lines(net: DataFrame) -> DataFrame:
    """Every segment as a line with one bend, from its own place to its target's."""
    x, y = F.col("subc_id") % 40 + 0.0, F.floor(F.col("subc_id") / 40) + 0.0
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    to = F.when(F.col("target") < 0, point(F.lit(41), F.lit(0))).otherwise(point(F.col("target") % 40, F.floor(F.col("target") / 40)))
    return net.select("subc_id", F.array(point(x, y), point(x + 0.3, y + 0.7), to).alias("geom"))


@query(_CUT, "net", "dams")
def g8_cut_buffers(spark: SparkSession, sf: str) -> DataFrame:
    net, lines = N.RiverNetwork(view(spark, sf, "net")), bent_lines(view(spark, sf, "net"))
    starts = view(spark, sf, "dams").select(F.col("site_id").alias("start"), F.col("subc_id").alias("id"), ((F.col("site_id") % 5) / 5.0).alias("fraction"))
    cut = S.cut_lines(lines, H.walk_budget(net, starts, 5000.0, 7000.0), planar=True)
    end = lambda k, c: F.round(F.element_at("geom", k)[c], 6)
    return cut.select("start", F.col("id").alias("subc_id"), end(1, "x").alias("x1"), end(1, "y").alias("y1"), end(-1, "x").alias("x2"), end(-1, "y").alias("y2"), F.size("geom").alias("n_points"), F.round(F.col("fraction_end") - F.col("fraction_start"), 6).alias("share"))


@query(
    f"WITH {_SHAPED.split('g AS (')[0].rstrip().rstrip(',')}, w AS (SELECT poly_id, sum(x1 * y2 - x2 * y1) AS w, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS wx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS wy FROM (SELECT poly_id, x1, y1, x2, y2 FROM e) GROUP BY 1)"
    " SELECT poly_id, round(abs(w) / 2, 6) AS area, round(wx / (3 * w), 6) AS x, round(wy / (3 * w), 6) AS y FROM w"
)
def k21_shape_centroids(spark: SparkSession, sf: str) -> DataFrame:
    t = P.ring_measures(_shaped(spark, sf), "poly_id", planar=True)
    return t.select("poly_id", *[F.round(c, 6).alias(c) for c in ("area", "x", "y")])


@query(
    "WITH l AS (SELECT subc_id, subc_id % 40 + 0.0 AS xa, subc_id // 40 + 0.0 AS ya, CASE WHEN target < 0 THEN 41.0 ELSE target % 40 END AS xc, CASE WHEN target < 0 THEN 0.0 ELSE target // 40 END AS yc FROM net), b AS (SELECT *, sqrt(0.58) AS l1, sqrt(pow(xc - xa - 0.3, 2) + pow(yc - ya - 0.7, 2)) AS l2 FROM l)"
    " SELECT subc_id, round((l1 * (xa + 0.15) + l2 * (xa + 0.3 + xc) / 2) / (l1 + l2), 6) AS x, round((l1 * (ya + 0.35) + l2 * (ya + 0.7 + yc) / 2) / (l1 + l2), 6) AS y FROM b",
    "net",
)
def k21_line_centroids(spark: SparkSession, sf: str) -> DataFrame:
    t = P.line_centroids(bent_lines(view(spark, sf, "net")), planar=True)
    return t.select("subc_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_KRUEGER = (
    "WITH c AS (SELECT 0.0016792203863836474::DOUBLE AS n), k AS (SELECT n, 6378137.0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) * 0.9996 AS r, n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 AS a1, 13 * n * n / 48 - 3 * pow(n, 3) / 5 AS a2, 61 * pow(n, 3) / 240 AS a3, 2 * sqrt(n) / (1 + n) AS e FROM c),"
    " p AS (SELECT *, CAST(floor((lon + 180) / 6) AS INT) + 1 AS zone FROM pts), s AS (SELECT p.*, k.*, radians(lon - (zone * 6 - 183)) AS d, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t FROM p, k),"
    " u AS (SELECT *, atan2(t, cos(d)) AS x, atanh(sin(d) / sqrt(1 + t * t)) AS y FROM s)"
    " SELECT id, zone, round(500000 + r * (y + a1 * cos(2 * x) * sinh(2 * y) + a2 * cos(4 * x) * sinh(4 * y) + a3 * cos(6 * x) * sinh(6 * y)), 3) AS east, round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + r * (x + a1 * sin(2 * x) * cosh(2 * y) + a2 * sin(4 * x) * cosh(4 * y) + a3 * sin(6 * x) * cosh(6 * y)), 3) AS north FROM u"
)


@query(_KRUEGER, "pts")
def k21_projected_points(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "pts").withColumn("zone", P.zone_of(F.col("lon")))
    east, north = P.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("lat") < 0)
    return p.select("id", "zone", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query(
    "SELECT id, kind FROM (SELECT p.*, row_number() OVER (PARTITION BY round(lon, 1), kind ORDER BY id) AS n FROM pts p WHERE kind <> '' AND NOT EXISTS (SELECT 1 FROM sites s WHERE 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) <= 150000.0)) WHERE n = 1",
    "pts",
    "sites",
)
def b5_away_from_places(spark: SparkSession, sf: str) -> DataFrame:
    # records of a kind, one for each tenth of a degree, none near a site
    records = view(spark, sf, "pts").withColumn("tenth", F.round("lon", 1))
    return CL.occurrence_places(records, view(spark, sf, "sites"), 150_000.0, ("tenth", "kind"), "kind", ("id",)).select("id", "kind")


SQL["k11_snap_with_accumulation"] = MORE_SQL["k11_snap_to_cells"].replace("zone FROM cells)", "zone FROM cells WHERE value >= 30)")


@query()
def k11_snap_with_accumulation(spark: SparkSession, sf: str) -> DataFrame:
    # the quantities stand for accumulated flow; cells without one do not count
    cells = view(spark, sf, "cells").withColumn("cell_col", F.col("cell_col") * 13)
    streams = cells.select("cell_row", "cell_col", F.col("zone").alias("value"))
    return GEO.snap_to_cells(view(spark, sf, "pts"), streams, G.Grid(dx=0.5, dy=0.5), 10, cells, 30).select("id", "subc_id")


@query()
def m7_maximum_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Suitability of every sub-catchment for one species, its own presences against all; a fit in rounds has no SQL."""
    from thalweg.operators.maxent import fit_maxent, predict_maxent

    variables = view(spark, sf, "attrs")
    at = view(spark, sf, "occ").where("species = '2-HIGH'").select("subc_id").distinct()
    rows = variables.join(at, "subc_id", "left_semi").withColumn("observed", F.lit(1)).unionByName(variables.withColumn("observed", F.lit(0)))
    model = fit_maxent(rows, "observed", ["price_mean", "price_min", "price_max", "n_orders"])
    return predict_maxent(variables, model).select("subc_id", F.round("suitability", 6).alias("suitability"))
