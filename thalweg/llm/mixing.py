"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thalweg.llm.common import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Power of each level's observed share that makes its default target: below 1 small levels gain.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Share of the raked mass that may be in cells too small for their goal; they are drawn whole and fall short of it.
SLACK = 0.01
#: Share of the tokens that is drawn at least where all targets are the default ones.
LEAST = 0.5


def n_tokens_of(text: Column) -> Column:
    """Runs of characters other than white space (a null or empty text has none)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def form_of(text: Column) -> Column:
    """The form of a text, the topic where none is given.

    Marked: over a tenth of it is neither letters, white space nor the plain
    signs of prose. Lines: a line break in forty characters or fewer. Prose is
    short below 1,000 characters.
    """
    t = F.coalesce(text, F.lit(""))
    odd, breaks = F.regexp_count(t, F.lit(r"[^\p{L}\s.,;:!?'()-]")), F.length(t) - F.length(F.replace(t, F.lit("\n")))
    return F.when(odd * 10 > F.length(t), "marked").when(breaks * 40 > F.length(t), "lines").when(F.length(t) < 1000, "short prose").otherwise("long prose")


def cells_of(rows: DataFrame) -> DataFrame:
    """Token mass of each (source, lang, topic): pre-aggregated map-side, so a hot source costs nothing."""
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("mass")).where("mass > 0")


def target_table(spark: SparkSession, targets: DataFrame | dict[str, dict[str, float]] | None) -> DataFrame:
    """Targets as a table (dimension, level, share), from such a table or {dimension: {level: share}}."""
    if isinstance(targets, DataFrame):
        return targets.select(F.col("dimension").cast("string").alias("dimension"), F.col("level").cast("string").alias("level"), F.col("share").cast("double").alias("share"))
    return spark.createDataFrame([(d, level, float(share)) for d, levels in (targets or {}).items() for level, share in levels.items()], "dimension string, level string, share double")


def with_goals(cells: DataFrame, targets: DataFrame) -> tuple[DataFrame, float]:
    """The cells with the mass that each level of each dimension shall have, and the total mass.

    Shares are as given (rescaled to the levels that occur; a level without a
    share gets none), else the observed ones tempered. The window sums run over
    cells, which are few beside the documents, and three sums and the total
    reach the driver.
    """
    given = {r["dimension"] for r in targets.where(F.col("dimension").isin(*DIMENSIONS)).select("dimension").distinct().collect()}  # at most three
    out, spread = cells, []
    for d in DIMENSIONS:
        have = F.sum("mass").over(W.partitionBy(d))
        wanted = F.pow(have, F.lit(TEMPER[d]))
        if d in given:
            shares = targets.where(F.col("dimension") == d).groupBy(F.col("level").alias(d)).agg(F.sum("share").alias(f"_share_{d}"))
            out = out.join(shares, d, "left")
            wanted = F.coalesce(f"_share_{d}", F.lit(0.0))
        out = out.withColumn(f"_have_{d}", have).withColumn(f"_goal_{d}", wanted)
        spread.append(F.sum(F.col(f"_goal_{d}") * F.col("mass") / F.col(f"_have_{d}")).alias(d))  # a level's cells share it out
    out = materialize(out, "goals")
    sums = out.agg(F.sum("mass").alias("total"), *spread).first()
    total = sums["total"] or 0.0
    return out.select(*DIMENSIONS, "mass", *[(F.col(f"_goal_{d}") * F.lit(total / sums[d] if sums[d] else 0.0)).alias(f"goal_{d}") for d in DIMENSIONS]), total


def rake(cells: DataFrame, targets: DataFrame | dict[str, dict[str, float]] | None = None, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """Weights of the cells whose weighted mass has the target marginals: source, lang, topic, mass, weight.

    Each round scales the weights to the marginals of one dimension after the
    other. Two rounds are one plan over the small cell table, written out so
    that the lineage stays short, and a single number (the largest relative
    error of a marginal before its last scaling) tells when to stop. Goals that
    contradict each other are never met: a warning names the error that is left.
    """
    now, total = with_goals(cells, target_table(cells.sparkSession, targets))
    now = now.withColumn("weight", F.lit(1.0))
    goals = [f"goal_{d}" for d in DIMENSIONS]
    if not total:
        return now.drop(*goals)
    for _ in range(0, rounds, 2):
        for _ in range(2):
            off = F.lit(0.0)
            for d in DIMENSIONS:
                have = F.sum(F.col("mass") * F.col("weight")).over(W.partitionBy(d))
                now = now.withColumn(f"_by_{d}", F.when(have > 0, F.col(f"goal_{d}") / have).otherwise(F.lit(0.0))).withColumn("weight", F.col("weight") * F.col(f"_by_{d}"))
                lost = F.when((have <= 0) & (F.col(f"goal_{d}") > 0), 1.0).otherwise(0.0)  # other goals leave nothing of the level
                off = F.greatest(off, F.when(F.col(f"_by_{d}") > 0, F.abs(F.col(f"_by_{d}") - 1)).otherwise(lost))
            now = now.select(*DIMENSIONS, "mass", *goals, "weight", off.alias("off"))
        now = materialize(now, "raking")
        error = now.agg(F.max("off")).first()[0] or 0.0
        if error < tolerance:
            break
    else:
        warnings.warn(f"raking has not settled: a marginal is {error:.3g} of its goal off after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return now.drop("off", *goals)


def full_weight(raked: DataFrame, least: float) -> float:
    """The weight from which on documents are drawn for certain; 0 if there is none.

    The largest weight would keep the marginals exactly, but one tiny cell
    would then starve all others. So the cells of the largest weights are drawn
    whole as long as they hold at most ``SLACK`` of the raked mass, and further
    ones until the draw is expected to hold ``least`` of the tokens. Weights
    are summed in bins of a 16th of an octave, so at most 1,025 rows reach the
    driver.
    """
    some = raked.where("weight > 0")
    top = some.agg(F.max("weight")).first()[0]
    if not top:
        return 0.0
    at = F.least(F.floor(F.log2(F.lit(top) / F.col("weight")) * 16), F.lit(1024))
    bins = some.groupBy(at.alias("bin")).agg(F.max("weight").alias("weight"), F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.col("weight")).alias("raked"))
    found = [(r["weight"], r["mass"], r["raked"]) for r in bins.orderBy("bin").collect()]
    tokens, goal = sum(m for _, m, _ in found), sum(r for _, _, r in found)
    whole, cut = 0.0, 0.0
    for weight, mass, share in found:
        if cut + share > SLACK * goal and whole + (goal - cut) / weight >= least * tokens:
            break
        whole, cut = whole + mass, cut + share
    if cut > SLACK * goal:
        warnings.warn(f"cells with {cut / goal:.3g} of the raked mass are too small for their goals and are drawn whole", RuntimeWarning, stacklevel=2)
    return weight


def label(docs: DataFrame, *more: Column, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic (null levels as their own), n_tokens and the columns asked for."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")],
        F.coalesce((form_of(F.col("text")) if topic is None else topic).cast("string"), F.lit("(none)")).alias("topic"),
        n_tokens_of(F.col("text")).alias("n_tokens"),
        *more,
    )


def mix(docs: DataFrame, targets: DataFrame | dict[str, dict[str, float]] | None = None, seed: int = 11, keep: tuple[str, ...] = (), topic: Column | None = None) -> DataFrame:
    """Rake token weights to source, language and topic marginals and draw documents by them.

    ``targets`` is a table (dimension, level, share) or {dimension: {level:
    share}}; a dimension without targets gets its observed shares, tempered.
    ``topic`` is a column of ``docs`` that tells a document's topic; without it
    the form of the text stands for it (``form_of``). Returns doc_id, source,
    lang, topic, n_tokens, weight, probability, sampled and the columns in
    ``keep`` (as ``_0``, ``_1`` ... so that they cannot clash), one row for
    each input row; an empty table gives none.

    The probability is the cell's weight over ``full_weight``, at most 1: the
    expected mix has the raked marginals but for the cells that are drawn
    whole, which fall short together by at most ``SLACK`` of it (by more, with a
    warning, if no targets are given and less than ``LEAST`` of the tokens would
    be left). A document is drawn if a hash of (doc_id, text, seed) falls below
    it, so the draw is the same on every run and for repeated rows. Rows without
    tokens have weight 0 and are not drawn; a null source or language is a level
    of its own.
    """
    rows = label(docs, F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("_draw"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)], topic=topic)
    cells = materialize(cells_of(label(docs, topic=topic)), "cells")
    raked = rake(cells, targets)
    full = full_weight(raked, LEAST if targets is None else 0.0)
    weights = raked.select(*DIMENSIONS, "weight", (F.least(F.col("weight") / F.lit(full), F.lit(1.0)) if full > 0 else F.lit(0.0)).alias("probability"))
    out = rows.join(weights, list(DIMENSIONS), "left")
    uniform = F.pmod(F.col("_draw"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    probability = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    return out.select("doc_id", *DIMENSIONS, "n_tokens", F.when(F.col("n_tokens") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0).alias("weight"), probability.alias("probability"), (uniform < probability).alias("sampled"), *[f"_{k}" for k in range(len(keep))])
