"""River networks as edge tables: reachability, accumulation, distances, order, centrality.

A network has one row for each segment: ``id`` flows into ``target``; a target
of -1 (or null, or an id that no row has) is an outlet. All fixpoints work by
pointer doubling, so their number of joins is the logarithm of the longest
path, and every round is written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thalweg.operators.components import components
from thalweg.plans.scratch import apart as materialize
from thalweg.plans.scratch import partitions

STATS: dict[str, Callable[[str], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "sd": F.stddev_samp,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
}


def stat_column(stat: str | Callable[[str], Column], name: str) -> Column:
    """A named statistic or a user's function of a column name; a sum over nothing is 0, the others are null."""
    return (STATS[stat] if isinstance(stat, str) else stat)(name)


class RiverNetwork:
    """Edges (id, target, weight and attributes) of an in-forest. Joins shuffle them: a network is no table to broadcast."""

    def __init__(self, edges: DataFrame, id: str | None = None, target: str | None = None, weight: str | None = "length"):
        def first(choices: tuple[str, ...]) -> str:
            found = [c for c in choices if c in edges.columns]
            if not found:
                raise ValueError(f"none of the columns {choices} is there")
            return found[0]

        id = id or first(("subc_id", "stream", "from"))
        target = target or first(("target", "next_stream", "to"))
        rest = [c for c in edges.columns if c not in (id, target)]
        weight_column = F.col(weight).cast("double") if weight and weight in edges.columns else F.lit(1.0)
        self.edges = edges.select(F.col(id).cast("long").alias("id"), F.col(target).cast("long").alias("target"), weight_column.alias("weight"), *rest).hint("merge")

    @property
    def links(self) -> DataFrame:
        """Edges between two segments of the network, without the virtual root."""
        ids = self.edges.select(F.col("id").alias("target"))
        return self.edges.join(ids, "target", "left_semi").select("id", "target", "weight").hint("merge")

    def with_cut(self, cut: Column) -> RiverNetwork:
        """The network without the out-edges of the segments for which ``cut`` holds."""
        out = RiverNetwork.__new__(RiverNetwork)
        out.edges = self.edges.withColumn("target", F.when(F.coalesce(cut, F.lit(False)), F.lit(-1)).otherwise(F.col("target")))
        return out

    def part(self, ids: DataFrame) -> RiverNetwork:
        """The segments in ``ids`` (a column id); what flows out of them ends."""
        out = RiverNetwork.__new__(RiverNetwork)
        out.edges = self.edges.join(ids.select("id").distinct(), "id", "left_semi").hint("merge")
        return out

    def where(self, condition: Column | str) -> RiverNetwork:
        out = RiverNetwork.__new__(RiverNetwork)
        out.edges = self.edges.where(condition)
        return out

    def validate(self) -> None:
        """Each id once, and no cycle."""
        if not self.edges.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("a segment has more than one target")
        _doubled(self.links.select("id", F.col("target").alias("to")), {}, lambda *_: False)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _doubled(jump: DataFrame, carried: dict[str, Callable[[Column, Column], Column]], step: Callable[[DataFrame, int], bool | None], limit: int = 40) -> None:
    """Calls ``step`` with the jumps over 1, 2, 4 ... edges until none is left or it returns True.

    A jump has id, to and the carried columns; those of two jumps in a row are
    joined by the functions given (upper, lower).
    """
    jump = materialize(jump, "jump")
    for k in range(limit):
        if jump.isEmpty() or step(jump, k):
            return
        left = jump.alias("a")
        right = jump.alias("b")
        jump = materialize(left.join(right, F.col("a.to") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.to").alias("to"), *[join(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c, join in carried.items()]), "jump")
    raise ValueError("the network has a cycle")


def _jumps(net: RiverNetwork) -> DataFrame:
    """One edge each: id, to, its weight d, its number of edges h, and the weight w0 of the segment it starts at."""
    return net.links.select("id", F.col("target").alias("to"), F.col("weight").alias("d"), F.lit(1).cast("long").alias("h"), F.col("weight").alias("w0"))


_CARRIED = {"d": _add, "h": _add, "w0": lambda a, b: a}


def outlets(net: RiverNetwork) -> DataFrame:
    """Segments without an out-edge."""
    return net.edges.select("id").join(net.links.select("id"), "id", "left_anti")


def headwaters(net: RiverNetwork) -> DataFrame:
    """Segments into which nothing flows."""
    return net.edges.select("id").join(net.links.select(F.col("target").alias("id")), "id", "left_anti")


def roots(net: RiverNetwork) -> DataFrame:
    """(id, root, hops, dist): the outlet below each segment, edges to it, and their weights' sum.

    The weight of an edge is that of its upstream segment, so the outlet's own
    weight does not count; ``out_dist`` adds it.
    """
    state = {"at": net.edges.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("hops"), F.lit(0.0).alias("dist"))}

    def step(jump: DataFrame, k: int) -> None:
        # segments already moved over fewer than 2**k edges stand at their root or exactly 2**k edges down
        state["jumps"].append(jump)

    state["jumps"] = []
    _doubled(_jumps(net), _CARRIED, step)
    # longest jumps first: after each, less than that many edges are left
    at = state["at"]
    for jump in reversed(state["jumps"]):
        j = jump.select(F.col("id").alias("root"), F.col("to").alias("_to"), F.col("d").alias("_d"), F.col("h").alias("_h"))
        at = at.join(j, "root", "left").select("id", F.coalesce("_to", "root").alias("root"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), (F.col("dist") + F.coalesce("_d", F.lit(0.0))).alias("dist"))
    return at.hint("merge")


def closure(net: RiverNetwork, include_self: bool = True, seeds: DataFrame | None = None) -> DataFrame:
    """(base, stream, hops, dist): every stream that drains through base, base itself as wanted.

    Pairs within 2**k edges are joined with the jumps over 2**k edges to give
    those within 2**(k+1): each pair is made once. With ``seeds`` (a column id)
    only their pairs are built, the jumps being taken upstream from them.
    """
    own = net.edges.select("id") if seeds is None else seeds.select(F.col("id").cast("long").alias("id")).distinct().join(net.edges.select("id"), "id", "left_semi")
    state = {"pairs": own.select(F.col("id").alias("stream"), F.col("id").alias("base"), F.lit(0).cast("long").alias("hops"), F.lit(0.0).alias("dist"))}

    def step(jump: DataFrame, k: int) -> None:
        pairs = state["pairs"]
        if seeds is None:
            j = jump.select(F.col("id").alias("base"), F.col("to").alias("_to"), F.col("d").alias("_d"), F.col("h").alias("_h"))
            longer = pairs.join(j, "base").select("stream", F.col("_to").alias("base"), (F.col("hops") + F.col("_h")).alias("hops"), (F.col("dist") + F.col("_d")).alias("dist"))
        else:
            j = jump.select(F.col("to").alias("stream"), F.col("id").alias("_id"), F.col("d").alias("_d"), F.col("h").alias("_h"))
            longer = pairs.join(j, "stream").select(F.col("_id").alias("stream"), "base", (F.col("hops") + F.col("_h")).alias("hops"), (F.col("dist") + F.col("_d")).alias("dist"))
        state["pairs"] = materialize(pairs.unionByName(longer), "closure")

    _doubled(_jumps(net), _CARRIED, step)
    pairs = state["pairs"].select("base", "stream", "hops", "dist")
    return pairs if include_self else pairs.where("hops > 0")


def walk_down(net: RiverNetwork, seeds: DataFrame, include_self: bool = True) -> DataFrame:
    """(base, stream, hops, dist): the path from each seed to its outlet, by pointer doubling from the seeds."""
    starts = seeds.select(F.col("id").cast("long").alias("id")).distinct().join(net.edges.select("id"), "id", "left_semi")
    pairs = reach(net, starts.select(F.col("id").alias("base"), "id", F.lit(None).cast("double").alias("limit")))
    return (pairs if include_self else pairs.where("hops > 0")).select("base", "stream", "hops", "dist")


def reach(net: RiverNetwork, starts: DataFrame, upstream: bool = False) -> DataFrame:
    """(base, stream, hops, dist): the segments that a way from each start comes to within its limit.

    ``starts`` has base (a name of the start), id and limit (null: none). The
    way downstream comes to a segment if the weights of those passed before sum
    to less than the limit, the start's own included; upstream the start's own
    does not count. ``dist`` is the sum of the edges' weights between the two.
    Pairs beyond the limit are dropped in the round that meets them and rounds
    end with the first that finds nothing, so their number is the logarithm of
    the longest way within the limit.
    """
    state = {"pairs": starts.select("base", F.col("id").cast("long").alias("stream"), "limit", F.lit(0).cast("long").alias("hops"), F.lit(0.0).alias("dist"))}
    at, to = ("to", "id") if upstream else ("id", "to")

    def step(jump: DataFrame, k: int) -> bool:
        pairs = state["pairs"]
        j = jump.select(F.col(at).alias("stream"), F.col(to).alias("_to"), F.col("d").alias("_d"), F.col("h").alias("_h"), F.col("w0").alias("_w"))
        longer = pairs.join(j, "stream").select("base", F.col("_to").alias("stream"), "limit", (F.col("hops") + F.col("_h")).alias("hops"), (F.col("dist") + F.col("_d")).alias("dist"), F.col("_w"))
        passed = F.col("dist") - F.col("_w") if upstream else F.col("dist")
        longer = materialize(longer.where(F.col("limit").isNull() | (passed < F.col("limit"))).drop("_w"), "ways")
        if longer.isEmpty():
            return True
        state["pairs"] = materialize(pairs.unionByName(longer), "ways")
        return False

    _doubled(_jumps(net), _CARRIED, step)
    return state["pairs"].select("base", "stream", "hops", "dist")


def path_fold(net: RiverNetwork, values: DataFrame, how: str = "sum", factor: Column | None = None) -> DataFrame:
    """(id, value): sum, min or max of ``values`` (id, value) over the way from each segment to its outlet, both included.

    After k rounds a segment holds the fold over the first 2**k segments of its
    way. With ``factor``, a column of the edges, the rest of the way is
    multiplied by it at each edge: value(id) + factor(id) * fold(target).
    """
    scale = F.lit(1.0) if factor is None else factor.cast("double")
    links = net.edges.join(net.edges.select(F.col("id").alias("target")), "target", "left_semi").select("id", F.col("target").alias("to"), scale.alias("f"))
    join = {"sum": lambda a, b, f: F.coalesce(a, F.lit(0.0)) + f * F.coalesce(b, F.lit(0.0)), "min": lambda a, b, f: F.least(a, b), "max": lambda a, b, f: F.greatest(a, b)}[how]
    state = {"held": materialize(net.edges.select("id").join(values.select("id", F.col("value").cast("double").alias("value")), "id", "left"), "folded")}

    def step(jump: DataFrame, k: int) -> None:
        held = state["held"]
        below = jump.join(held.select(F.col("id").alias("to"), F.col("value").alias("_v")), "to").select("id", "_v", "f")
        folded = held.join(below, "id", "left")
        state["held"] = materialize(folded.select("id", F.when(F.col("f").isNull(), F.col("value")).otherwise(join(F.col("value"), F.col("_v"), F.col("f"))).alias("value")), "folded")

    _doubled(links, {"f": lambda a, b: a * b}, step)
    return state["held"]


def catchment_edges(net: RiverNetwork, seeds: DataFrame | None = None, use_outlet: bool = False, mode: str = "in") -> DataFrame:
    """(seed, id, target): edges whose both ends the seed reaches upstream (in), downstream (out) or either way (all)."""
    if use_outlet:
        found = outlets(net)
        seeds = found if seeds is None else seeds.select("id").unionByName(found).distinct()
    if seeds is None:
        raise ValueError("seeds or use_outlet is needed")
    if mode == "in":
        members = closure(net, seeds=seeds).select(F.col("base").alias("seed"), F.col("stream").alias("id"))
    elif mode == "out":
        members = walk_down(net, seeds).select(F.col("base").alias("seed"), F.col("stream").alias("id"))
    elif mode == "all":
        root = materialize(roots(net).select("id", "root"), "roots")
        members = root.join(seeds.select(F.col("id").alias("seed")).distinct(), F.col("id") == F.col("seed")).select("seed", "root").join(root, "root").select("seed", "id")
    else:
        raise ValueError("mode is in, out or all")
    edges = members.join(net.links.select("id", "target"), "id")
    ends = members.select("seed", F.col("id").alias("target"))
    return edges.join(ends, ["seed", "target"], "left_semi").select("seed", "id", "target")


def accumulate(net: RiverNetwork, columns: dict[str, tuple[str, str]], values: DataFrame | None = None, include_focal: bool = True, factor: Column | None = None) -> DataFrame:
    """Upstream sum, min, max or count of columns for every segment, without building the closure.

    ``columns`` maps a result to (column, sum | min | max | count); ``values``
    (id and columns; else the network's attributes) has at most one row for
    each id. After k rounds a segment holds its upstream values within 2**k
    edges; the next round adds those of the segments exactly 2**k edges above.
    Whole numbers are summed as such. With ``factor``, a column of the edges,
    what flows over an edge is multiplied by it.
    """
    source = net.edges if values is None else net.edges.select("id").join(values, "id", "left")
    combine = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    whole = {f.name for f in source.schema.fields if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")} if factor is None else set()
    start = source.select("id", *[(F.col(c).isNotNull().cast("long") if s == "count" else F.col(c).cast("long" if c in whole else "double")).alias(out) for out, (c, s) in columns.items()])
    state = {"held": materialize(start, "accumulated")}
    links = net.edges.join(net.edges.select(F.col("id").alias("target")), "target", "left_semi").select("id", F.col("target").alias("to"), *([] if factor is None else [factor.cast("double").alias("f")]))

    def step(jump: DataFrame, k: int) -> None:
        held = state["held"]
        above = held.join(jump, "id").select(F.col("to").alias("id"), *[(F.col(c) if factor is None else F.col(c) * F.col("f")).alias(c) for c in columns])
        state["held"] = materialize(held.unionByName(above).groupBy("id").agg(*[combine[s](out).alias(out) for out, (_, s) in columns.items()]), "accumulated")

    _doubled(links, {} if factor is None else {"f": lambda a, b: a * b}, step)
    out = state["held"]
    if not include_focal:
        out = out.join(links.withColumnRenamed("to", "base"), "id").groupBy("base").agg(*[combine[s](F.col(o) if factor is None else F.col(o) * F.col("f")).alias(o) for o, (_, s) in columns.items()]).withColumnRenamed("base", "id").hint("merge")
    return out


def _upstream_moments(net: RiverNetwork, variables: DataFrame, names: list[str], stat: str, seeds: DataFrame | None, include_focal: bool) -> DataFrame:
    """``upstream_variable`` for statistics that follow from counts, sums, sums of squares and extremes."""
    centre = dict.fromkeys(names, 0.0)
    if stat == "sd":  # squares are taken around the overall means, so that large values do not swallow the spread
        row = variables.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names]).first()
        centre = {c: row[c] or 0.0 for c in names}
    own, plan = [F.count("*").alias("_rows")], {"_rows": ("_rows", "sum")}
    for k, c in enumerate(names):
        shifted = F.col(c).cast("double") - F.lit(centre[c])
        parts = {"sum": [("s", F.sum(c), "sum")], "min": [("m", F.min(c), "min")], "max": [("m", F.max(c), "max")], "mean": [("n", F.count(c), "sum"), ("s", F.sum(c), "sum")], "sd": [("n", F.count(c), "sum"), ("s", F.sum(shifted), "sum"), ("q", F.sum(shifted * shifted), "sum")]}[stat]
        for mark, value, how in parts:
            own.append(value.alias(f"_{mark}{k}"))
            plan[f"_{mark}{k}"] = (f"_{mark}{k}", how)
    each = materialize(variables.groupBy("id").agg(*own), "own-values")
    out = accumulate(net, plan, each, include_focal)
    if seeds is not None:
        out = out.join(seeds.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    elif not include_focal:
        out = out.unionByName(headwaters(net).join(each, "id").select("id", *plan))

    def value(k: int) -> Column:
        n, s, q = F.col(f"_n{k}"), F.col(f"_s{k}"), F.col(f"_q{k}")
        if stat == "sum":
            return F.coalesce(s, F.lit(0))
        if stat == "mean":
            return F.when(n > 0, s / n)
        if stat == "sd":
            return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1))))
        return F.col(f"_m{k}")

    return out.where("_rows > 0").select(F.col("id").alias("base"), *[value(k).alias(c) for k, c in enumerate(names)])


def upstream_variable(net: RiverNetwork, variables: DataFrame, names: list[str], stat: str | Callable[[str], Column], seeds: DataFrame | None = None, include_focal: bool = False, connections: DataFrame | None = None, on: str = "id") -> DataFrame:
    """(base, each name): a statistic of the variables over everything upstream of each segment.

    Without seeds all segments are bases, and a headwater, which has nothing
    upstream, uses its own values even if the focal segment is left out
    otherwise. With seeds only they are bases and headwaters give no row.
    Sum, mean, sd, min and max are accumulated down the network; the median and
    a caller's function need all pairs (base, stream), those of the seeds only.
    ``connections`` (base, stream) reuses a stored closure.
    """
    if connections is None and stat in ("sum", "mean", "sd", "min", "max"):
        return _upstream_moments(net, variables.select(F.col(on).cast("long").alias("id"), *names), names, stat, seeds, include_focal)
    pairs = connections
    if pairs is None:
        pairs = closure(net, include_self=include_focal, seeds=seeds).select("base", "stream")
        if seeds is None and not include_focal:
            pairs = pairs.unionByName(headwaters(net).select(F.col("id").alias("base"), F.col("id").alias("stream")))
    joined = pairs.join(variables.select(F.col(on).alias("stream"), *names), "stream")
    return joined.groupBy("base").agg(*[stat_column(stat, c).alias(c) for c in names])


def upstream_distances(table: DataFrame, id: str = "stream", target: str = "next_stream", out_dist: str = "out_dist") -> DataFrame:
    """(stream, stream_up, dist_m): whole metres between each segment and all strictly upstream ones."""
    net = RiverNetwork(table, id, target, None)
    d = table.select(F.col(id).cast("long").alias("k"), F.col(out_dist).cast("double").alias("d")).dropna()
    pairs = closure(net, include_self=False).select(F.col("base").alias("stream"), F.col("stream").alias("stream_up"))
    a, b = d.select(F.col("k").alias("stream"), F.col("d").alias("da")), d.select(F.col("k").alias("stream_up"), F.col("d").alias("db"))
    return pairs.join(a, "stream").join(b, "stream_up").select("stream", "stream_up", F.round(F.col("db") - F.col("da")).cast("long").alias("dist_m"))


def neighbours(net: RiverNetwork, order: int, mode: str = "in", seeds: DataFrame | None = None) -> DataFrame:
    """(id, neighbour): segments within ``order`` edges up (in), down (out) or either way (all), without the segment itself."""
    links = net.links.select("id", "target")
    steps = {"in": links.select(F.col("target").alias("at"), F.col("id").alias("next")), "out": links.select(F.col("id").alias("at"), F.col("target").alias("next"))}
    steps["all"] = steps["in"].unionByName(steps["out"])
    step = materialize(steps[mode], "steps")
    start = (net.edges if seeds is None else seeds).select("id").distinct()
    frontier = found = start.select("id", F.col("id").alias("at"))
    for _ in range(order):
        nearest = frontier.join(step, "at").select("id", F.col("next").alias("at")).distinct()
        if mode == "all":
            nearest = nearest.join(found, ["id", "at"], "left_anti")
        frontier = materialize(nearest, "frontier")
        found = found.unionByName(frontier)
    return found.where("id <> at").select("id", F.col("at").alias("neighbour"))


def neighbour_variable(pairs: DataFrame, variables: DataFrame, names: list[str], stat: str | Callable[[str], Column], compat_focal: bool = False, on: str = "id") -> DataFrame:
    """(id, each name): a statistic over the neighbours' values; of the focal segment's own, repeated, if asked for."""
    key = "id" if compat_focal else "neighbour"
    return pairs.join(variables.select(F.col(on).alias(key), *names), key, "left").groupBy("id").agg(*[stat_column(stat, c).alias(c) for c in names])


def with_via(ways: DataFrame) -> DataFrame:
    """Ways with via: the segment from which each comes to a segment, its own where it begins."""
    return ways.withColumn("via", F.coalesce(F.lag("stream").over(W.partitionBy("base").orderBy("hops")), F.col("stream")))


def meetings(paths: DataFrame, block: int = 2000, nearest: str | None = None) -> DataFrame:
    """Each pair of ways (base, stream, hops, dist, more) once, at the first segment that both come to: a, b, meet.

    ``a`` and ``b`` are structs of the two rows, all columns but stream. Two
    ways meet where they come in from different neighbours (or one begins
    there), so only such groups are joined, and what a segment passes on below
    is never compared again. Groups of over ``block`` ways are dealt in parts on
    both sides; a task has a few meetings of two parts. With ``nearest``, a
    column, of the ways with one of its values that come in from one neighbour
    only the nearest is met, and ``merged`` says how many they are.
    """
    ways = paths if "via" in paths.columns else with_via(paths)
    rows = ways.select("stream", "via", F.struct(*[c for c in paths.columns if c not in ("stream", "via")]).alias("row"))
    if nearest is not None:
        best = rows.groupBy("stream", "via", f"row.{nearest}").agg(F.min_by("row", F.struct("row.dist", "row.base")).alias("r"), F.count("*").alias("merged"))
        rows = best.select("stream", "via", F.struct("r.*", "merged").alias("row"))
    rows = materialize(rows, "ways")
    sizes = rows.groupBy("stream", "via").agg(F.count("*").alias("n"))
    side = lambda s: sizes.select("stream", F.col("via").alias(s), F.col("n").alias(f"n_{s}"), F.ceil(F.col("n") / F.lit(block)).alias(f"cut_{s}"))
    groups = materialize(side("lo").join(side("hi"), "stream").where("lo < hi"), "groups")
    pairs = groups.agg(F.sum(F.col("n_lo").cast("double") * F.col("n_hi"))).first()[0] or 0.0
    n = max(partitions(paths.sparkSession), min(math.ceil(pairs / (block * block)), 20_000))
    keys = ["stream", "lo", "hi", "i", "j"]
    own = lambda s: F.pmod(F.xxhash64("row.base"), F.col(f"cut_{s}"))
    every = lambda s: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"cut_{s}") - 1))
    a = groups.join(rows.withColumnRenamed("via", "lo"), ["stream", "lo"]).select("stream", "lo", "hi", own("lo").alias("i"), every("hi").alias("j"), F.col("row").alias("a"))
    b = groups.join(rows.withColumnRenamed("via", "hi"), ["stream", "hi"]).select("stream", "lo", "hi", every("lo").alias("i"), own("hi").alias("j"), F.col("row").alias("b"))
    return a.repartition(n, *keys).hint("merge").join(b.repartition(n, *keys), keys).select("a", "b", F.col("stream").alias("meet"))


def pair_distances(net: RiverNetwork, points: DataFrame, hops: bool = False, include_ends: bool = False) -> DataFrame:
    """(from, to, distance or segments) of all unordered pairs of the given ids that are connected.

    The distance runs over the lowest common segment: D(a) + D(b) - 2 D(c). Each
    edge weighs as its upstream segment. Pairs in different basins have no row.
    Only the points' own paths are built, and each pair is made once.
    """
    ways = walk_down(net, points)
    if include_ends:
        ways = ways.join(net.edges.select(F.col("id").alias("stream"), F.col("weight").alias("w")), "stream")
    met = meetings(ways)
    ends = (F.least("a.base", "b.base").alias("from"), F.greatest("a.base", "b.base").alias("to"))
    if hops:
        return met.select(*ends, (F.col("a.hops") + F.col("b.hops")).alias("segments"))
    d = F.col("a.dist") + F.col("b.dist")
    return met.select(*ends, (d + F.col("a.w") if include_ends else d).alias("distance"))


def _way_to(net: RiverNetwork, low: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, root, dist, way): the way from each segment, up or down, to the one of ``ends`` (root, end) in its basin."""
    stem = walk_down(net, ends.select(F.col("end").alias("id"))).select(F.col("stream").alias("id"), F.lit(True).alias("_stem"))
    cut = RiverNetwork.__new__(RiverNetwork)
    cut.edges = net.edges.select("id", "target", "weight").join(stem, "id", "left").select("id", F.when(F.col("_stem"), F.lit(-1)).otherwise(F.col("target")).alias("target"), "weight").hint("merge")
    to_stem = roots(cut).select("id", F.col("root").alias("_at"), F.col("dist").alias("_up"))
    depth = low.select(F.col("id").alias("_at"), F.col("dist").alias("_below"))
    far = low.join(ends, "root").where("id = end").select("root", F.col("dist").alias("_end")).hint("merge")
    return low.join(to_stem, "id").join(depth, "_at").join(far, "root").select("id", "root", "dist", (F.col("_up") + F.col("_end") - F.col("_below")).alias("way")).hint("merge")


def centrality(net: RiverNetwork, mode: str = "in") -> DataFrame:
    """subc_id, degree, farness, closeness, eccentricity (over what is reachable) and betweeness.

    The last name is kept as users know it. In an in-forest directed paths are
    unique, so the paths through a segment are those from each segment above to
    each segment below; it does not depend on the mode. A segment that reaches
    nothing has no closeness, farness 0 is null. Everything follows from the
    distances D to the outlets: their number, sum and maximum upstream, and
    their sum along the way down. Mode all goes both ways along the edges; its
    farness changes by weight * (all - 2 * upstream) with each edge, and the
    farthest segment is one of the two ends of the basin's longest way.
    """
    if mode not in ("in", "out", "all"):
        raise ValueError("mode is in, out or all")
    low = materialize(roots(net), "roots")
    up = accumulate(net, {"n": ("hops", "count"), "s": ("dist", "sum"), "m": ("dist", "max")}, low)
    path = path_fold(net, low.select("id", F.col("dist").alias("value"))).withColumnRenamed("value", "path")
    t = materialize(low.join(up, "id").join(path, "id"), "distances")
    links = net.links
    for part in (links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("deg_in")), links.groupBy("id").agg(F.count("*").alias("deg_out"))):
        t = t.join(part, "id", "left")
    n_up, n_down = F.col("n") - 1, F.col("hops")
    far_up = F.when(n_up > 0, F.col("s") - F.col("n") * F.col("dist"))
    deg_in, deg_out = F.coalesce("deg_in", F.lit(0)), F.coalesce("deg_out", F.lit(0))
    if mode == "in":
        far, ecc, degree = far_up, F.col("m") - F.col("dist"), deg_in
    elif mode == "out":
        far, ecc, degree = F.when(n_down > 0, (n_down + 1) * F.col("dist") - F.col("path")), F.col("dist"), deg_out
    else:
        basin = t.where("id = root").select("root", F.col("n").alias("_all"), F.col("s").alias("_far")).hint("merge")
        turn = t.join(basin, "root").join(net.edges.select("id", "weight"), "id").select("id", F.when(F.col("id") == F.col("root"), 0.0).otherwise(F.col("weight") * (F.col("_all") - 2 * F.col("n"))).alias("value"))
        turned = path_fold(net, turn).withColumnRenamed("value", "_turn")
        first = low.groupBy("root").agg(F.max_by("id", F.struct("dist", "id")).alias("end"))
        one = materialize(_way_to(net, low, first), "first-end")
        second = one.groupBy("root").agg(F.max_by("id", F.struct("way", "id")).alias("end"))
        two = _way_to(net, low, second).select("id", F.col("way").alias("_two"))
        t = t.join(basin, "root").join(turned, "id").join(one.select("id", F.col("way").alias("_one")), "id").join(two, "id")
        far, ecc, degree = F.when(F.col("_all") > 1, F.col("_far") + F.col("_turn")), F.greatest("_one", "_two"), deg_in + deg_out
    return t.select(F.col("id").alias("subc_id"), degree.alias("degree"), far.alias("farness"), F.when(far > 0, 1 / far).alias("closeness"), F.coalesce(ecc, F.lit(0.0)).alias("eccentricity"), (n_up * n_down).alias("betweeness"))


def shreve_orders(net: RiverNetwork) -> DataFrame:
    """(id, shreve): the number of headwaters above each segment, a headwater's own included; one accumulation."""
    return accumulate(net, {"shreve": ("head", "sum")}, headwaters(net).select("id", F.lit(1).alias("head")))


def strahler_orders(net: RiverNetwork) -> DataFrame:
    """(id, strahler): the largest order above, one more where it comes twice.

    The segments of order k + 1 or more are those below a segment into which
    two of order k or more flow, so there is one accumulation for each order,
    over the segments of the order before: their number at least halves at the
    headwaters each time. Only these are read and written for an order.
    """
    high, orders = net, []
    while True:
        orders.append(high.edges.select("id", F.lit(len(orders) + 1).cast("long").alias("strahler")))
        joins = high.links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(1).alias("joint"))
        joins = materialize(joins, "joints")
        if joins.isEmpty():
            return reduce(DataFrame.unionByName, orders).groupBy("id").agg(F.max("strahler").alias("strahler")).hint("merge")
        below = accumulate(high, {"joints": ("joint", "sum")}, joins).where("joints > 0")
        part = high.part(below)
        part.edges = materialize(part.edges.select("id", "target", "weight"), "orders")
        high = part


def stream_orders(net: RiverNetwork) -> DataFrame:
    """id, strahler, shreve: both orders of each segment."""
    return strahler_orders(net).join(shreve_orders(net), "id").select("id", "strahler", "shreve")


def fragments(net: RiverNetwork, cut: Column) -> DataFrame:
    """(id, fragment): the pieces left when the out-edges for which ``cut`` holds go; named by their lowest segment."""
    return roots(net.with_cut(cut)).select("id", F.col("root").alias("fragment"))


def induced_components(net: RiverNetwork, ids: DataFrame, min_size: int = 1) -> DataFrame:
    """(id, patch): weak components of the segments in ``ids``; named by their smallest id; only those of ``min_size`` or more."""
    keep = ids.select("id").distinct()
    inside = net.part(keep)
    low = materialize(roots(inside).select("id", "root"), "patches")
    name = low.groupBy("root").agg(F.min("id").alias("patch"), F.count("*").alias("n")).where(F.col("n") >= min_size)
    return low.join(name, "root").select("id", "patch")


def weak_components(net: RiverNetwork) -> DataFrame:
    """(node, component) for networks that are no forest; isolated segments have no row."""
    return components(net.links.select(F.col("id").alias("a"), F.col("target").alias("b")))
