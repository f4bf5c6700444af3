"""Table builders: prediction and model-fit tables, keep-first, dissolve, chunks, sampling, reshaping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ID_STATS = ("min", "max", "range", "mean", "sd")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key: the first in a stated order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def keep_best(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """Of each key the row with the largest value, ties to the smallest ``tie``; hash-aggregated, without a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(value), (-F.col(tie)).alias("t"))).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def table_stats(df: DataFrame, id: str, statistics: Sequence[str]) -> DataFrame:
    """The id and the chosen statistics of a six-column table (id and five statistics); other tables stay whole."""
    unknown = [s for s in statistics if s not in (*ID_STATS, "ALL")]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}")
    rest = [c for c in df.columns if c != id]
    if len(rest) != 5 or "ALL" in statistics:
        return df
    return df.select(id, *[c for s in statistics for c in rest if c == s or c.endswith(f"_{s}")])


def predict_table(ids: DataFrame, variables: dict[str, Sequence[DataFrame]], id: str = "subc_id", statistics: Sequence[str] = ("ALL",), land_cover: Callable[[str], bool] = lambda v: False, digits: int = 2) -> DataFrame:
    """Wide table of the wanted ids: one column for each variable and statistic.

    Tiles of a variable are united after the wanted ids were picked (a semi
    join before anything else), decimals rounded, an id that several tiles hold
    taken from the first tile, columns prefixed by the variable unless it is a
    land cover, and all variables joined to the id list by id.
    """
    wanted = ids.select(F.col(id).cast("long").alias(id)).dropna().distinct()
    parts = []
    for name, tiles in variables.items():
        united = None
        for k, tile in enumerate(tiles):
            t = table_stats(tile.withColumn(id, F.col(id).cast("long")), id, statistics).join(wanted, id, "left_semi")
            t = t.select(id, *[(F.round(c, digits) if t.schema[c].dataType.typeName() in ("double", "float") else F.col(c)).alias(c if land_cover(name) or c.startswith(f"{name}_") else f"{name}_{c}") for c in t.columns if c != id], F.lit(k).alias("_tile"))
            united = t if united is None else united.unionByName(t, allowMissingColumns=True)
        parts.append(keep_first(united, [id], ["_tile", *[c for c in united.columns if c not in (id, "_tile")]]).drop("_tile"))
    return reduce(lambda a, b: a.join(b, id, "left"), parts, wanted)


def modelfit_table(points: DataFrame, predictors: DataFrame, pseudo_absences: int = 0, id: str = "subc_id", exclude_presences: bool = True, seed: int = 1) -> DataFrame:
    """Presence 1 rows of the points' sub-catchments with their predictors, and pseudo-absences labelled 0.

    Points without a sub-catchment (null or 0) go. Pseudo-absences are drawn
    from the predictor table by a seeded hash, so a run can be repeated.
    """
    present = points.where(F.col(id).isNotNull() & (F.col(id) != 0)).select(id).distinct()
    ones = predictors.join(present, id, "left_semi").select(id, F.lit(1).alias("pres_abs"), *[c for c in predictors.columns if c != id])
    if not pseudo_absences:
        return ones
    rest = predictors.join(present, id, "left_anti") if exclude_presences else predictors
    zeros = sample_rows(rest, pseudo_absences, [id], seed).select(id, F.lit(0).alias("pres_abs"), *[c for c in predictors.columns if c != id])
    return ones.unionByName(zeros)


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 1) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their keys: the same on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def absences(presences: DataFrame, candidates: DataFrame, prevalence: float, id: str, seed: int = 1) -> DataFrame:
    """As many candidates that are no presences as give the prevalence: round(n * (1 - p) / p)."""
    n = presences.select(id).distinct().count()
    return sample_rows(candidates.join(presences, id, "left_anti"), round(n * (1 - prevalence) / prevalence), [id], seed)


def dissolve(df: DataFrame, id: str) -> DataFrame:
    """One row for each id; every other column its distinct values, sorted and joined by commas."""
    return df.groupBy(id).agg(*[F.concat_ws(",", F.array_sort(F.collect_set(F.col(c).cast("string")))).alias(c) for c in df.columns if c != id])


def chunked(df: DataFrame, order: Sequence[str], size: int, compat: bool = False) -> DataFrame:
    """A chunk number for each row, from 1 in the given order; with ``compat`` the first chunk is one row short.

    Row numbers come from per-range counts (ranges by the first order column),
    so no task holds all rows.
    """
    numbered = row_numbers(df, order)
    shift = F.lit(0) if compat else F.lit(1)
    return numbered.withColumn("chunk", F.floor((F.col("row_no") - shift) / size) + 1)


def row_numbers(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """row_no from 1 over the whole order: numbered inside ranges, plus the number of rows in the ranges before."""
    from thalweg.plans.scratch import materialize, partitions

    n = parts or partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, order[0]).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a number for each range
    base, total = [], 0
    for p in sorted(sizes):
        base.append((p, total))
        total += sizes[p]
    bases = df.sparkSession.createDataFrame(base or [(0, 0)], "_part int, _base long")
    w = W.partitionBy("_part").orderBy(*order)
    return ranged.join(F.broadcast(bases), "_part").withColumn("row_no", F.row_number().over(w) + F.col("_base")).drop("_part", "_base")


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both over the columns that both have."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common).unionByName(b.select(*common))


def natural_left(a: DataFrame, b: DataFrame) -> DataFrame:
    """Left join on all common columns."""
    return a.join(b, [c for c in a.columns if c in b.columns], "left")


def select_like(df: DataFrame, starts: str | None = None, ends: str | None = None, contains: str | None = None, matches: str | None = None) -> DataFrame:
    """Columns whose names fit all that is given."""
    import re

    return df.select(*[c for c in df.columns if (starts is None or c.startswith(starts)) and (ends is None or c.endswith(ends)) and (contains is None or contains in c) and (matches is None or re.search(matches, c))])


def rescale(df: DataFrame, rules: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Each column that a rule's pattern matches goes through it; the first matching rule counts."""
    import re

    def fit(c: str) -> Column:
        for pattern, f in rules.items():
            if re.search(pattern, c):
                return f(F.col(c)).alias(c)
        return F.col(c)

    return df.select(*[fit(c) for c in df.columns])


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), from one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "nulls")


def positive_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, positive): rows with a value above 0, from one pass."""
    return df.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in columns]).unpivot([], list(columns), "column", "positive")


def normalise(df: DataFrame, column: str, floor: float = 1e-6) -> DataFrame:
    """(x - min) / (max - min), at least ``floor``, as ``<column>_norm``; the extremes are one row."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.join(F.broadcast(ends)).withColumn(f"{column}_norm", F.greatest(F.lit(floor), F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0))).drop("_lo", "_hi")


def priority_dedupe(df: DataFrame, keys: Sequence[str], priority: str, tie: str) -> DataFrame:
    """Of rows with the same keys the one with the best (smallest) priority."""
    return keep_first(df, keys, [F.col(priority).asc_nulls_last(), tie])


def ensemble(models: dict[str, DataFrame], id: str, value: str) -> DataFrame:
    """Full outer join of the models' predictions: id, one column each, n_models, mean over those that are there."""
    named = [df.select(id, F.col(value).alias(m)) for m, df in models.items()]
    wide = reduce(lambda a, b: a.join(b, id, "full"), named)
    there = F.filter(F.array(*models), lambda x: x.isNotNull())
    return wide.withColumn("n_models", F.size(there)).withColumn("ens_mean", F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0)))


def jaccard(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    """One row: shared, only_a, only_b, jaccard of two id sets."""
    x, y = a.select(id).distinct().withColumn("_a", F.lit(1)), b.select(id).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, id, "full").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))
    return both.withColumn("jaccard", F.try_divide(F.col("shared").cast("double"), F.col("shared") + F.col("only_a") + F.col("only_b")))


def boundary_length(matrix: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: summed boundary between selected and other units."""
    inside = matrix.join(selected.select(F.col("id").alias("id1")), "id1", "left_semi").join(selected.select(F.col("id").alias("id2")), "id2", "left_anti")
    return inside.agg(F.coalesce(F.sum("boundary"), F.lit(0.0)).alias("boundary_length"))
