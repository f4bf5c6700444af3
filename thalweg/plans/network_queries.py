"""Registered queries over river networks, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators import habitat as H
from thalweg.operators import network as N
from thalweg.plans.fixtures import sql, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, *views: str):
    """Registers a function under its name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, *views)
        return f

    return add


def _net(spark: SparkSession, sf: str, name: str = "net") -> N.RiverNetwork:
    return N.RiverNetwork(view(spark, sf, name))


#: All (base, stream) pairs: stream drains through base.
CLOSURE = """c(base, stream, hops, dist) AS (
  SELECT subc_id, subc_id, 0::BIGINT, 0.0::DOUBLE FROM {0} UNION ALL
  SELECT n.target, c.stream, c.hops + 1, c.dist + n.length FROM c JOIN {0} n ON n.subc_id = c.base JOIN {0} t ON t.subc_id = n.target)"""


def closed(body: str, name: str = "net", extra: str = "") -> str:
    return f"WITH RECURSIVE {CLOSURE.format(name)}{', ' + extra if extra else ''} {body}"


@query(closed("SELECT base AS subc_id, round(sum(n.length), 2) AS up_length FROM c JOIN net n ON n.subc_id = c.stream GROUP BY base"), "net")
def g2_upstream_sum(spark: SparkSession, sf: str) -> DataFrame:
    out = N.accumulate(_net(spark, sf), {"up_length": ("weight", "sum")})
    return out.select(F.col("id").alias("subc_id"), F.round("up_length", 2).alias("up_length"))


@query(closed("SELECT base AS subc_id, round(min(price_mean), 2) AS lo, round(max(price_mean), 2) AS hi, count(price_mean) AS n FROM c LEFT JOIN attrs a ON a.subc_id = c.stream GROUP BY base"), "net", "attrs")
def g2_upstream_min_max_count(spark: SparkSession, sf: str) -> DataFrame:
    values = view(spark, sf, "attrs").withColumnRenamed("subc_id", "id")
    out = N.accumulate(_net(spark, sf), {"lo": ("price_mean", "min"), "hi": ("price_mean", "max"), "n": ("price_mean", "count")}, values)
    return out.withColumnRenamed("id", "subc_id")


def _stat(stat: str, duck: str, focal: bool, digits: int = 4):
    heads = "" if focal else " WHERE hops > 0 OR base NOT IN (SELECT target FROM net)"

    @query(closed(f"SELECT base AS subc_id, round({duck}, {digits}) AS v FROM (SELECT base, stream FROM c{heads}) JOIN attrs a ON a.subc_id = stream GROUP BY base"), "net", "attrs")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = N.upstream_variable(_net(spark, sf), view(spark, sf, "attrs"), ["price_mean"], stat, include_focal=focal, on="subc_id")
        return out.select(F.col("base").alias("subc_id"), F.round("price_mean", digits).alias("v"))

    name = f"g2_upstream_{stat}" + ("_with_focal" if focal else "")
    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_stat("mean", "avg(price_mean)", False)
_stat("median", "median(price_mean)", True)
_stat("sd", "stddev_samp(price_mean)", False, 3)


@query(closed("SELECT base AS subc_id, round(sum(n_orders), 0)::BIGINT AS n FROM c JOIN attrs a ON a.subc_id = stream WHERE base IN (5, 17, 40, 99) GROUP BY base"), "net", "attrs")
def g2_upstream_seeds(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([(5,), (17,), (40,), (99,)], "id long")
    out = N.upstream_variable(_net(spark, sf), view(spark, sf, "attrs"), ["n_orders"], "sum", seeds, True, on="subc_id")
    return out.select(F.col("base").alias("subc_id"), F.col("n_orders").cast("long").alias("n"))


@query(closed("SELECT base AS seed, stream AS subc_id, n.target FROM c JOIN net n ON n.subc_id = c.stream WHERE base IN (3, 20) AND hops > 0"), "net")
def g1_catchment_in(spark: SparkSession, sf: str) -> DataFrame:
    out = N.catchment_edges(_net(spark, sf), spark.createDataFrame([(3,), (20,), (3,)], "id long"))
    return out.withColumnRenamed("id", "subc_id")


@query(closed("SELECT stream AS seed, base AS subc_id, n.target FROM c JOIN net n ON n.subc_id = c.base WHERE stream IN (77, 100) AND n.target >= 0"), "net")
def g1_catchment_out(spark: SparkSession, sf: str) -> DataFrame:
    out = N.catchment_edges(_net(spark, sf), spark.createDataFrame([(77,), (100,)], "id long"), mode="out")
    return out.withColumnRenamed("id", "subc_id")


@query(closed("SELECT r.stream AS seed, n.subc_id, n.target FROM c r JOIN (SELECT base, stream FROM c WHERE base IN (SELECT subc_id FROM net_forest WHERE target = -1)) m ON m.base = r.base JOIN net_forest n ON n.subc_id = m.stream WHERE r.stream IN (33, 62) AND n.target >= 0", "net_forest"), "net_forest")
def g1_catchment_all(spark: SparkSession, sf: str) -> DataFrame:
    out = N.catchment_edges(_net(spark, sf, "net_forest"), spark.createDataFrame([(33,), (62,)], "id long"), mode="all")
    return out.withColumnRenamed("id", "subc_id")


@query(closed("SELECT base AS seed, count(*) AS n FROM c JOIN net_forest n ON n.subc_id = c.stream WHERE base IN (SELECT subc_id FROM net_forest WHERE target = -1) AND n.target >= 0 GROUP BY base", "net_forest"), "net_forest")
def g1_outlet_catchments(spark: SparkSession, sf: str) -> DataFrame:
    return N.catchment_edges(_net(spark, sf, "net_forest"), use_outlet=True).groupBy("seed").agg(F.count("*").alias("n"))


@query(closed("SELECT base AS stream, stream AS stream_up, CAST(round(u.length - b.length) AS BIGINT) AS dist_m FROM c JOIN net_forest b ON b.subc_id = c.base JOIN net_forest u ON u.subc_id = c.stream WHERE hops > 0", "net_forest"), "net_forest")
def g3_upstream_distances(spark: SparkSession, sf: str) -> DataFrame:
    return N.upstream_distances(view(spark, sf, "net_forest"), "subc_id", "target", "length")


PAIR = """p AS (SELECT a.stream AS i, b.stream AS j, min(a.dist + b.dist) AS d, min(a.hops + b.hops) AS h FROM c a JOIN c b ON a.base = b.base AND a.stream < b.stream WHERE a.stream % {0} = 3 AND b.stream % {0} = 3 GROUP BY 1, 2)"""


@query(closed('SELECT i AS "from", j AS "to", round(d, 2) AS distance FROM p', extra=PAIR.format(29)), "net")
def g4_pair_distance(spark: SparkSession, sf: str) -> DataFrame:
    net = _net(spark, sf)
    return N.pair_distances(net, net.edges.where("id % 29 = 3").select("id")).withColumn("distance", F.round("distance", 2))


@query(closed('SELECT i AS "from", j AS "to", h AS segments FROM p', "net_forest", PAIR.format(31)), "net_forest")
def g4_pair_segments(spark: SparkSession, sf: str) -> DataFrame:
    net = _net(spark, sf, "net_forest")
    return N.pair_distances(net, net.edges.where("id % 31 = 3").select("id"), hops=True)


@query(
    closed(
        """SELECT n.subc_id, coalesce(di, 0) AS degree, round(f, 2) AS farness, round(1 / f, 10) AS closeness, round(coalesce(e, 0), 2) AS eccentricity, coalesce(u, 0) * coalesce(w, 0) AS betweeness FROM net n
LEFT JOIN (SELECT base, count(*) AS u, sum(dist) AS f, max(dist) AS e FROM c WHERE hops > 0 GROUP BY base) a ON a.base = n.subc_id
LEFT JOIN (SELECT stream, count(*) AS w FROM c WHERE hops > 0 GROUP BY stream) b ON b.stream = n.subc_id
LEFT JOIN (SELECT target, count(*) AS di FROM net GROUP BY target) d ON d.target = n.subc_id"""
    ),
    "net",
)
def g5_centrality(spark: SparkSession, sf: str) -> DataFrame:
    t = N.centrality(_net(spark, sf))
    return t.select("subc_id", "degree", F.round("farness", 2).alias("farness"), F.round("closeness", 10).alias("closeness"), F.round("eccentricity", 2).alias("eccentricity"), "betweeness")


@query(closed("SELECT base AS subc_id, stream AS neighbour FROM c WHERE hops BETWEEN 1 AND 3"), "net")
def g6_neighbours_in(spark: SparkSession, sf: str) -> DataFrame:
    return N.neighbours(_net(spark, sf), 3).withColumnRenamed("id", "subc_id")


@query(closed("SELECT DISTINCT a.stream AS subc_id, b.stream AS neighbour FROM c a JOIN c b ON a.base = b.base WHERE a.stream <> b.stream AND a.hops + b.hops <= 2"), "net")
def g6_neighbours_all(spark: SparkSession, sf: str) -> DataFrame:
    return N.neighbours(_net(spark, sf), 2, "all").withColumnRenamed("id", "subc_id")


@query(closed("SELECT base AS subc_id, round(avg(price_mean), 4) AS price_mean FROM c LEFT JOIN attrs a ON a.subc_id = c.stream WHERE hops BETWEEN 1 AND 3 GROUP BY base"), "net", "attrs")
def g6_neighbour_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = N.neighbour_variable(N.neighbours(_net(spark, sf), 3), view(spark, sf, "attrs"), ["price_mean"], "mean", on="subc_id")
    return out.select(F.col("id").alias("subc_id"), F.round("price_mean", 4).alias("price_mean"))


ROOT = "r AS (SELECT stream, max_by(base, hops) AS root, max(hops) AS hops, max(dist) AS dist FROM c GROUP BY stream)"


@query(closed("SELECT stream AS subc_id, root, hops, round(dist, 2) AS dist FROM r", "net_deep", ROOT), "net_deep")
def g_root_distance_deep(spark: SparkSession, sf: str) -> DataFrame:
    return N.roots(_net(spark, sf, "net_deep")).select(F.col("id").alias("subc_id"), "root", "hops", F.round("dist", 2).alias("dist"))


@query(closed("SELECT base AS subc_id, round(sum(n.length), 2) AS cum_length, count(*) AS n FROM c JOIN net_deep n ON n.subc_id = stream GROUP BY base", "net_deep"), "net_deep")
def g_cumulative_length_deep(spark: SparkSession, sf: str) -> DataFrame:
    net = _net(spark, sf, "net_deep")
    out = N.accumulate(net, {"cum_length": ("weight", "sum"), "n": ("weight", "count")})
    return out.select(F.col("id").alias("subc_id"), F.round("cum_length", 2).alias("cum_length"), "n")


@query(closed("SELECT base AS subc_id, count(*) AS shreve FROM c WHERE stream NOT IN (SELECT target FROM net) GROUP BY base"), "net")
def g_shreve(spark: SparkSession, sf: str) -> DataFrame:
    return N.shreve_orders(_net(spark, sf)).select(F.col("id").alias("subc_id"), "shreve")


# in the binary tree a segment's Strahler order follows from the children's, level by level
@query(
    """WITH RECURSIVE lv AS (SELECT subc_id, 0 AS d FROM net WHERE subc_id = 0 UNION ALL SELECT n.subc_id, lv.d + 1 FROM net n JOIN lv ON n.target = lv.subc_id),
s(step, done) AS (
  SELECT (SELECT max(d) FROM lv), MAP([-1::BIGINT], [0]) UNION ALL
  SELECT step - 1, map_concat(done, (SELECT MAP(list(id), list(o)) FROM (
    SELECT lv.subc_id AS id, CASE WHEN count(k.subc_id) = 0 THEN 1 WHEN count(k.subc_id) > 1 AND min(done[k.subc_id]) = max(done[k.subc_id]) THEN max(done[k.subc_id]) + 1 ELSE max(done[k.subc_id]) END AS o
    FROM lv LEFT JOIN net k ON k.target = lv.subc_id WHERE lv.d = step GROUP BY lv.subc_id))) FROM s WHERE step >= 0)
SELECT u.k AS subc_id, u.v::BIGINT AS strahler FROM (SELECT unnest(map_keys(done)) AS k, unnest(map_values(done)) AS v FROM s WHERE step = -1) u WHERE u.k >= 0""",
    "net",
)
def g_strahler(spark: SparkSession, sf: str) -> DataFrame:
    return N.strahler_orders(_net(spark, sf)).select(F.col("id").alias("subc_id"), "strahler")


CUT = """cut AS (SELECT subc_id, CASE WHEN barrier THEN -1 ELSE target END AS target, length FROM net)"""


def _fragments(body: str) -> str:
    return f"WITH RECURSIVE {CUT}, {CLOSURE.format('cut')}, f AS (SELECT stream AS subc_id, max_by(base, hops) AS fragment FROM c GROUP BY stream) {body}"


@query(_fragments("SELECT subc_id, fragment FROM f"), "net")
def g12_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return N.fragments(_net(spark, sf), F.col("barrier")).withColumnRenamed("id", "subc_id")


@query(_fragments("SELECT count(*) AS n_fragments, round(sum(l), 2) AS total_len, round(median(l), 2) AS median_len, round(max(l), 2) AS max_len, round(avg(l), 2) AS mean_len FROM (SELECT fragment, sum(length) AS l FROM f JOIN net USING (subc_id) GROUP BY fragment)"), "net")
def g12_fragment_summary(spark: SparkSession, sf: str) -> DataFrame:
    net = _net(spark, sf)
    return H.fragment_summary(N.fragments(net, F.col("barrier")), net.edges)


@query("SELECT n.subc_id, n.target, coalesce(d.n, 0) AS n_dams, coalesce(d.n, 0) > 0 AS barrier FROM net n LEFT JOIN (SELECT subc_id, count(*) AS n FROM dams GROUP BY subc_id) d USING (subc_id)", "net", "dams")
def g11_scenario_graph(spark: SparkSession, sf: str) -> DataFrame:
    return H.scenario_graph(_net(spark, sf), view(spark, sf, "dams")).select(F.col("id").alias("subc_id"), "target", "n_dams", "barrier")


def _suitable(spark: SparkSession, sf: str, rest: str = "id % 7 not in (2, 5)") -> DataFrame:
    return view(spark, sf, "net").select(F.col("subc_id").alias("id")).where(rest)


GOOD = "good AS (SELECT subc_id, CASE WHEN target IN (SELECT subc_id FROM net WHERE {0}) THEN target ELSE -1 END AS target, length FROM net WHERE {0})"


def _patches(where: str, body: str) -> str:
    return f"WITH RECURSIVE {GOOD.format(where)}, {CLOSURE.format('good')}, r AS (SELECT stream, max_by(base, hops) AS root FROM c GROUP BY stream), q AS (SELECT root, min(stream) AS patch, count(*) AS n FROM r GROUP BY root) {body}"


@query(_patches("subc_id % 7 NOT IN (2, 5)", "SELECT stream AS subc_id, patch FROM r JOIN q USING (root) WHERE n >= 2"), "net")
def g13_habitat_patches(spark: SparkSession, sf: str) -> DataFrame:
    return N.induced_components(_net(spark, sf), _suitable(spark, sf), 2).withColumnRenamed("id", "subc_id")


@query(
    _patches(
        "subc_id % 7 IN (2, 5)",
        """SELECT r.stream AS subc_id FROM r JOIN (
  SELECT r.root FROM r JOIN net n ON n.subc_id = r.stream GROUP BY r.root HAVING sum(n.length) <= 9000
    AND bool_or(r.stream IN (SELECT target FROM net WHERE subc_id % 7 NOT IN (2, 5))) AND bool_or(n.target >= 0 AND n.target % 7 NOT IN (2, 5))) k USING (root)""",
    ),
    "net",
)
def g10_fill_habitat_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return H.fill_habitat_gaps(_net(spark, sf), _suitable(spark, sf), 12000.0, 9000.0).withColumnRenamed("id", "subc_id")


@query("SELECT subc_id FROM net a WHERE subc_id % 5 IN (1, 2) AND ((target >= 0 AND target % 5 IN (1, 2)) OR EXISTS (SELECT 1 FROM net b WHERE b.target = a.subc_id AND b.subc_id % 5 IN (1, 2)))", "net")
def g18_drop_isolated(spark: SparkSession, sf: str) -> DataFrame:
    return H.drop_isolated(_net(spark, sf), _suitable(spark, sf, "id % 5 in (1, 2)")).withColumnRenamed("id", "subc_id")


@query(closed("SELECT least(pa, pb) AS patch_a, greatest(pa, pb) AS patch_b, round(min(d), 2) AS distance FROM (SELECT a.stream // 16 AS pa, b.stream // 16 AS pb, a.dist + b.dist AS d FROM c a JOIN c b ON a.base = b.base AND a.stream < b.stream WHERE a.stream % 16 < 2 AND b.stream % 16 < 2) WHERE pa <> pb GROUP BY 1, 2"), "net")
def g14_patch_distance(spark: SparkSession, sf: str) -> DataFrame:
    net = _net(spark, sf)
    patches = net.edges.where("id % 16 < 2").select("id", F.expr("id div 16").alias("patch"))
    return H.patch_distances(net, patches).withColumn("distance", F.round("distance", 2))


@query(closed("SELECT a.stream // 16 AS patch, round(min(a.dist + b.dist), 2) AS distance FROM c a JOIN c b ON a.base = b.base WHERE a.stream % 16 < 2 AND b.stream IN (SELECT subc_id FROM dams WHERE status = 'existing') GROUP BY 1"), "net", "dams")
def g15_nearest_dam(spark: SparkSession, sf: str) -> DataFrame:
    net = _net(spark, sf)
    patches = net.edges.where("id % 16 < 2").select("id", F.expr("id div 16").alias("patch"))
    dams = view(spark, sf, "dams").where("status = 'existing'").select(F.col("subc_id").alias("id"))
    return H.nearest_dam(net, patches, dams).withColumn("distance", F.round("distance", 2))


@query(f"WITH RECURSIVE {GOOD.format('subc_id % 7 NOT IN (2, 5)')}, gc AS (SELECT g.subc_id, CASE WHEN n.barrier THEN -1 ELSE g.target END AS target, g.length FROM good g JOIN net n USING (subc_id)), {CLOSURE.format('gc')}, f AS (SELECT stream, max_by(base, hops) AS fragment FROM c GROUP BY stream), o AS (SELECT subc_id, count(*) AS k FROM occ GROUP BY 1) SELECT fragment, count(*) AS n_segments, round(sum(length), 2) AS len, coalesce(sum(k), 0)::BIGINT AS n_points FROM f JOIN net n ON n.subc_id = stream LEFT JOIN o ON o.subc_id = stream GROUP BY fragment", "net", "occ")
def g17_fragments_with_habitat(spark: SparkSession, sf: str) -> DataFrame:
    points = view(spark, sf, "occ").select(F.col("subc_id").alias("id"))
    return H.fragments_with_habitat(_net(spark, sf), _suitable(spark, sf), points, "barrier").withColumn("len", F.round("len", 2))


@query(closed("SELECT n.subc_id AS dam, stream AS subc_id FROM c JOIN dams n ON n.subc_id = c.base WHERE status = 'planned'"), "net", "dams")
def g22_severed(spark: SparkSession, sf: str) -> DataFrame:
    dams = view(spark, sf, "dams").where("status = 'planned'").select(F.col("subc_id").alias("id"))
    return H.severed(_net(spark, sf), dams).withColumnRenamed("id", "subc_id")


DEWATER = "w AS (SELECT c.stream AS dam, c.base AS subc_id, coalesce(sum(n.length) OVER (PARTITION BY c.stream ORDER BY hops ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, n.length FROM c JOIN net n ON n.subc_id = c.base WHERE hops > 0 AND c.stream IN (SELECT subc_id FROM dams WHERE status = 'planned'))"


@query(closed("SELECT dam, subc_id FROM w WHERE before < 9000", extra=DEWATER), "net", "dams")
def g23_dewatered(spark: SparkSession, sf: str) -> DataFrame:
    dams = view(spark, sf, "dams").where("status = 'planned'").select(F.col("subc_id").alias("id"))
    return H.dewatered(_net(spark, sf), dams, 9000.0).withColumnRenamed("id", "subc_id")


@query(
    closed(
        """SELECT dam, power, suit_up, len_up, suit_down, len_down, damage, round(damage / power, 6) AS per_mw, row_number() OVER (ORDER BY damage DESC, dam) AS rank FROM (
SELECT d.subc_id AS dam, round(d.power_mw, 2) AS power, round(sum(coalesce(a.n_orders, 0)), 2)::DOUBLE AS suit_up, round(sum(n.length), 2) AS len_up, round(any_value(coalesce(x.sd, 0)), 2)::DOUBLE AS suit_down, round(any_value(coalesce(x.ld, 0)), 2) AS len_down,
  round(sum(coalesce(a.n_orders, 0)) + any_value(coalesce(x.sd, 0)), 2)::DOUBLE AS damage
FROM dams d JOIN c ON c.base = d.subc_id JOIN net n ON n.subc_id = c.stream LEFT JOIN attrs a ON a.subc_id = c.stream
LEFT JOIN (SELECT dam, sum(coalesce(n_orders, 0)) AS sd, sum(length) AS ld FROM w LEFT JOIN attrs USING (subc_id) WHERE before < 2000 GROUP BY dam) x ON x.dam = d.subc_id
WHERE d.status = 'planned' GROUP BY d.subc_id, d.power_mw)""",
        extra=DEWATER,
    ),
    "net",
    "dams",
    "attrs",
)
def g24_rank_dams(spark: SparkSession, sf: str) -> DataFrame:
    dams = view(spark, sf, "dams").where("status = 'planned'").select(F.col("subc_id").alias("id"), F.col("power_mw").alias("power"))
    suit = view(spark, sf, "attrs").select(F.col("subc_id").alias("id"), F.col("n_orders").cast("double").alias("suit"))
    t = H.rank_dams(_net(spark, sf), dams, suit)
    return t.select("dam", *[F.round(c, 2).alias(c) for c in ("power", "suit_up", "len_up", "suit_down", "len_down", "damage")], F.round("per_mw", 6).alias("per_mw"), "rank")


@query(
    f"WITH RECURSIVE {CUT}, {CLOSURE.format('cut')} SELECT a.stream AS id1, b.stream AS id2, round(1.0 / min(a.hops + b.hops), 6) AS boundary FROM c a JOIN c b ON a.base = b.base AND a.stream <> b.stream WHERE a.hops + b.hops <= 3 GROUP BY 1, 2",
    "net",
)
def g21_boundary_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return H.boundary_matrix(_net(spark, sf), 3).withColumn("boundary", F.round("boundary", 6))


PCI = """o AS (SELECT subc_id, count(*)::DOUBLE AS w FROM occ WHERE species = '1-URGENT' GROUP BY 1),
own AS (SELECT stream, base, hops, dist + n.length AS len, n.length AS own FROM c JOIN net n ON n.subc_id = c.base),
m AS (SELECT a.stream AS i, b.stream AS j, min_by(a.len + b.len - a.own, a.hops + b.hops) AS d FROM own a JOIN own b ON a.base = b.base AND a.stream < b.stream WHERE a.stream IN (SELECT subc_id FROM o) AND b.stream IN (SELECT subc_id FROM o) GROUP BY 1, 2)"""


@query(closed("SELECT (SELECT count(*) FROM o) AS n, count(*) AS pairs, round(((SELECT sum(w * w) FROM o) + 2 * sum(pow(0.5, d / 5000) * x.w * y.w)) / (SELECT sum(w) * sum(w) FROM o), 6) AS pci FROM m JOIN o x ON x.subc_id = i JOIN o y ON y.subc_id = j", extra=PCI), "net", "occ")
def g19_connectivity_index(spark: SparkSession, sf: str) -> DataFrame:
    w = view(spark, sf, "occ").where("species = '1-URGENT'").groupBy(F.col("subc_id").alias("id")).agg(F.count("*").cast("double").alias("weight"))
    return H.connectivity_index(_net(spark, sf), w, 0.5, 1 / 5000).withColumn("pci", F.round("pci", 6))


@query(closed("SELECT count(*) AS n_before, count(CASE WHEN ok THEN 1 END) AS n_after, round(avg(d), 2) AS mean_before, round(avg(CASE WHEN ok THEN d END), 2) AS mean_after, round((count(*) - count(CASE WHEN ok THEN 1 END)) / count(*) * 100, 2) AS lost_pct FROM (SELECT p.i, p.j, p.d, NOT EXISTS (SELECT 1 FROM hit h WHERE (h.i = p.i AND h.j = p.j)) AS ok FROM p)", extra=PAIR.format(37) + ", meet AS (SELECT a.stream AS i, b.stream AS j, min_by(a.base, a.hops + b.hops) AS m, min(a.hops + b.hops) AS h FROM c a JOIN c b ON a.base = b.base AND a.stream < b.stream WHERE a.stream % 37 = 3 AND b.stream % 37 = 3 GROUP BY 1, 2), path AS (SELECT i, j, x.base AS v FROM meet JOIN c x ON x.stream = i JOIN c y ON y.stream = x.base AND y.base = m UNION SELECT i, j, x.base FROM meet JOIN c x ON x.stream = j JOIN c y ON y.stream = x.base AND y.base = m), hit AS (SELECT DISTINCT i, j FROM path WHERE v IN (SELECT subc_id FROM dams WHERE status = 'existing'))"), "net", "dams")
def g26_pair_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    net = _net(spark, sf)
    dams = view(spark, sf, "dams").where("status = 'existing'").select(F.col("subc_id").alias("id"))
    return H.pair_connectivity(net, net.edges.where("id % 37 = 3").select("id"), dams)


@query(closed("SELECT DISTINCT base AS subc_id FROM c WHERE stream % 97 = 5 AND hops <= 2 UNION SELECT subc_id FROM net WHERE length > 9500"), "net")
def g9_partial_network(spark: SparkSession, sf: str) -> DataFrame:
    # order 4 for the segments of over 9500 m, so that ways stop at them; ways of at most two edges are asked for here
    net = _net(spark, sf)
    paths = N.walk_down(net, net.edges.where("id % 97 = 5").select("id")).where("hops <= 2").select(F.col("stream").alias("subc_id"))
    return paths.unionByName(net.edges.where("weight > 9500").select(F.col("id").alias("subc_id"))).distinct()


@query(
    closed(
        """SELECT DISTINCT subc_id FROM (SELECT subc_id FROM net WHERE length > 8000
UNION ALL SELECT base FROM (SELECT c.stream, c.base, c.hops, min(CASE WHEN n.length > 8000 THEN c.hops END) OVER (PARTITION BY c.stream) AS stop FROM c JOIN net n ON n.subc_id = c.base WHERE c.stream % 97 = 5 AND c.stream NOT IN (SELECT subc_id FROM net WHERE length > 8000)) WHERE stop IS NULL OR hops <= stop
UNION ALL SELECT stream FROM c WHERE base % 97 = 5 AND hops BETWEEN 1 AND 1)"""
    ),
    "net",
)
def g9_retained_network(spark: SparkSession, sf: str) -> DataFrame:
    net = _net(spark, sf)
    order = net.edges.select("id", F.when(F.col("weight") > 8000, 4).otherwise(1).alias("strahler"))
    return H.partial_network(net, order, net.edges.where("id % 97 = 5").select("id"), 4, 1).withColumnRenamed("id", "subc_id")


@query(
    """WITH RECURSIVE s AS (SELECT subc_id AS dam FROM dams WHERE status = 'existing'),
up(dam, subc_id, before) AS (SELECT dam, n.subc_id, 0.0::DOUBLE FROM s JOIN net n ON n.target = dam UNION ALL SELECT up.dam, n.subc_id, up.before + p.length FROM up JOIN net p ON p.subc_id = up.subc_id JOIN net n ON n.target = up.subc_id WHERE up.before + p.length < 6000),
down(dam, subc_id, before) AS (SELECT dam, dam, 0.0::DOUBLE FROM s UNION ALL SELECT down.dam, n.target, down.before + n.length FROM down JOIN net n ON n.subc_id = down.subc_id WHERE n.target >= 0 AND down.before + n.length < 4000),
z AS (SELECT subc_id FROM up UNION SELECT subc_id FROM down UNION SELECT dam FROM s)
SELECT round(sum(CASE WHEN subc_id IN (SELECT subc_id FROM z) THEN length ELSE 0 END), 2) AS zone_len, round(sum(length), 2) AS total_len, round(sum(CASE WHEN subc_id IN (SELECT subc_id FROM z) THEN length ELSE 0 END) / sum(length) * 100, 2) AS share_pct FROM net""",
    "net",
    "dams",
)
def g27_impact_share(spark: SparkSession, sf: str) -> DataFrame:
    dams = view(spark, sf, "dams").where("status = 'existing'").select(F.col("subc_id").alias("id"))
    return H.impact_share(_net(spark, sf), dams, 6000.0, 4000.0)


@query(
    """WITH RECURSIVE down(start, subc_id, rest) AS (SELECT subc_id, subc_id, 7000.0::DOUBLE FROM net WHERE subc_id % 50 = 9 UNION ALL SELECT start, n.target, rest - n.length FROM down JOIN net n USING (subc_id) WHERE n.target >= 0 AND rest - n.length > 0)
SELECT start, subc_id, 0.0::DOUBLE AS fraction_start, round(least(1, rest / n.length), 6) AS fraction_end FROM down JOIN net n USING (subc_id)""",
    "net",
)
def g8_buffer_downstream(spark: SparkSession, sf: str) -> DataFrame:
    net = _net(spark, sf)
    starts = net.edges.where("id % 50 = 9").select(F.col("id").alias("start"), "id", F.lit(0.0).alias("fraction"))
    out = H.walk_budget(net, starts, 0.0, 7000.0)
    return out.select("start", F.col("id").alias("subc_id"), "fraction_start", F.round("fraction_end", 6).alias("fraction_end"))
