"""Joins whose result is far larger than both of their sides."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.plans.scratch import apart, partitions


def crossed(many: DataFrame, few: DataFrame, key: str, value: str, part: int = 4096, run: int = 128) -> DataFrame:
    """The rows of ``many`` with each ``value`` that ``few`` (key, value) has for their key: an inner join by ``key``.

    For keys with many rows on both sides. Both are cut into parts of about
    ``part`` rows, each two parts of a key meet once, and the number of tasks
    follows from the rows that they make, not from the little that is read for
    them. A row takes ``run`` values in a row, the next row the same ones, so
    that a column file holds one column as runs and the other as repeats (of a
    multiple of 8, as its packing goes). A key's values are distinct.
    """
    many, few = apart(many, "many"), apart(few.select(key, value), "few")
    count = lambda t, n: t.groupBy(key).agg(F.count("*").alias(n))
    cut = lambda n: F.ceil(F.col(n) / F.lit(part)).cast("long")
    sizes = apart(count(many, "_m").join(count(few, "_f"), key).select("*", cut("_m").alias("_rows"), cut("_f").alias("_lists")), "sizes")
    made = sizes.agg(F.sum(F.col("_m").cast("double") * F.col("_f"))).first()[0] or 0.0
    n = max(partitions(many.sparkSession), min(math.ceil(made / (part * part)), 20_000))
    own = lambda c, *of: F.pmod(F.xxhash64(*of), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    lists = few.join(sizes, key).groupBy(key, own("_lists", value).alias("_i"), "_rows").agg(F.collect_list(value).alias("_all"))
    runs = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / run).cast("int")), lambda k: F.slice("_all", k * run + 1, run)))
    a = lists.select(key, "_i", "_rows", runs.alias("_values")).select(key, "_i", every("_rows").alias("_j"), "_values")
    b = many.join(sizes, key).select(*many.columns, own("_rows", *many.columns).alias("_j"), every("_lists").alias("_i"))
    keys = [key, "_i", "_j"]
    # the left side of a merge is read once: a run goes to all rows of a part before the next run
    met = a.repartition(n, *keys).hint("merge").join(b.repartition(n, *keys), keys)
    return met.select(*many.columns, F.explode("_values").alias(value))
