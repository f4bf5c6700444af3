"""Model evaluation: threshold sweeps, AUC, folds, collinearity, classes by quantile, knee point, tests."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _counts(preds: DataFrame, steps: int) -> DataFrame:
    """(t, tp, fn, fp, tn) at t = 0, 1/steps ... 1: scores are binned and counted first, so nothing is crossed."""
    binned = preds.select(F.least(F.lit(steps), F.greatest(F.lit(-1), F.floor(F.round(F.col("score") * steps, 9)).cast("int"))).alias("b"), F.col("observed").cast("int").alias("y")).groupBy("b").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    grid = preds.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("b"))
    full = grid.join(binned, "b", "left").select("b", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    w = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, W.currentRow)  # over at most steps + 2 rows
    total = full.agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    at = full.select("b", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp")).where("b >= 0")
    return at.join(F.broadcast(total)).select((F.col("b") / F.lit(float(steps))).alias("t"), F.col("tp"), (F.col("P") - F.col("tp")).alias("fn"), F.col("fp"), (F.col("N") - F.col("fp")).alias("tn"))


def tss_sweep(preds: DataFrame, steps: int = 100) -> DataFrame:
    """t, tss = share of presences at or above t + share of absences below t - 1."""
    c = _counts(preds, steps)
    return c.select("t", (F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")) + F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp")) - 1).alias("tss"))


def mcc_sweep(preds: DataFrame, steps: int = 100) -> DataFrame:
    """t, mcc: Matthews correlation, null where its denominator is 0."""
    c = _counts(preds, steps).select("t", *[F.col(x).cast("double").alias(x) for x in ("tp", "fp", "fn", "tn")])
    under = (F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn"))
    return c.select("t", F.when(under > 0, (F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / F.sqrt(under)).alias("mcc"))


def best_threshold(sweep: DataFrame, value: str) -> DataFrame:
    """The first threshold with the largest value (a sweep is small)."""
    return sweep.where(F.col(value).isNotNull()).orderBy(F.desc(F.round(value, 9)), "t").limit(1)


def auc(preds: DataFrame) -> DataFrame:
    """One row: mean over presences of the share of absences with a strictly lower score; ties count nothing.

    Counts for each score, then a running sum over ranges of the scores.
    """
    each = preds.groupBy("score").agg(F.count_if(F.col("observed") == 1).alias("p"), F.count_if(F.col("observed") == 0).alias("n"))
    bucket = F.floor(F.col("score") * 1000)
    each = each.withColumn("_b", bucket)
    sums = each.groupBy("_b").agg(F.sum("n").alias("bn"))
    before = sums.select("_b", F.coalesce(F.sum("bn").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # at most some thousand rows for scores in [0, 1]
    inner = W.partitionBy("_b").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    ranked = each.join(before, "_b").select("p", "n", (F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("below"))
    return ranked.agg((F.sum(F.col("p") * F.col("below").cast("double")) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def folds(df: DataFrame, id: str, observed: str = "observed", holdout: float = 0.2, few: int = 10, seed: int = 1) -> DataFrame:
    """A fold column: below ``few`` presences each presence is a fold of its own (jackknife), else a hashed hold-out is fold 1."""
    n = df.agg(F.count_if(F.col(observed) == 1)).first()[0]
    if n < few:
        here = F.coalesce(F.col(observed) == 1, F.lit(False))
        own = df.where(here).withColumn("fold", F.row_number().over(W.orderBy(id)))  # fewer than ``few`` rows
        return own.unionByName(df.where(~here).withColumn("fold", F.lit(0)))
    return df.withColumn("fold", (F.pmod(F.xxhash64(F.lit(seed), F.col(id)), F.lit(10_000)) < int(holdout * 10_000)).cast("int"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of complete rows, one pass over the data for all pairs."""
    full = df.select(*columns).dropna()
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = full.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def stepwise_vif(df: DataFrame, columns: Sequence[str], limit: float = 10.0) -> list[tuple[str, float]]:
    """Columns left after the one with the largest variance inflation factor was dropped while above the limit.

    The correlation matrix comes from one pass; the steps work on the matrix.
    """
    import numpy as np

    columns = list(columns)
    r = {(x["a"], x["b"]): x["r"] for x in correlations(df, columns).collect()} if len(columns) > 1 else {}
    while columns:
        m = np.array([[1.0 if a == b else r.get((a, b), r.get((b, a))) for b in columns] for a in columns], float)
        vif = np.diag(np.linalg.pinv(m))
        worst = int(np.argmax(vif))
        if vif[worst] <= limit or len(columns) == 1:
            return [(c, float(v)) for c, v in zip(columns, vif, strict=True)]
        columns.pop(worst)
    return []


def quantiles(df: DataFrame, column: str, probs: Sequence[float], bins: int = 1024, few: int = 10_000) -> DataFrame:
    """One row with an array of exact, linearly interpolated quantiles; null without values. NaN is no value.

    Values are counted in ``bins`` equal ranges; the range that holds a wanted
    place is cut again until at most ``few`` rows, or equal ones, are left.
    Only counts of bins and such a last range reach the driver.
    """
    spark = df.sparkSession
    v = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    first = v.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, found = first["n"], {}

    def look(lo: float, hi: float, base: int, places: list[int]) -> None:
        """``places`` of the order lie among the values from lo to hi, before which ``base`` values come."""
        inside = v.where(F.col("v").between(lo, hi))
        step = (hi - lo) / bins
        if lo == hi or step == 0 or lo + step == lo:
            values = [(r["v"], r["k"]) for r in inside.groupBy("v").agg(F.count("*").alias("k")).orderBy("v").collect()]  # no range is left to cut
            return take(values, base, places)
        at = F.least(F.floor((F.col("v") - lo) / step), F.lit(bins - 1)).alias("at")
        counts = inside.groupBy(at).agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("at").collect()
        for r in counts:
            own = [p for p in places if base <= p < base + r["k"]]
            if own and r["k"] <= few:
                values = v.where(F.col("v").between(r["lo"], r["hi"])).groupBy("v").agg(F.count("*").alias("k")).orderBy("v").collect()
                take([(x["v"], x["k"]) for x in values], base, own)
            elif own and (r["lo"] > lo or r["hi"] < hi):
                look(r["lo"], r["hi"], base, own)
            elif own:
                raise RuntimeError("the range of the values cannot be cut")
            base += r["k"]

    def take(values: list[tuple[float, int]], base: int, places: list[int]) -> None:
        for value, k in values:
            found.update({p: value for p in places if base <= p < base + k})
            base += k

    if not n:
        return spark.range(1).select(F.lit(None).cast("array<double>").alias("q"))
    wanted = [(n - 1) * float(p) for p in probs]
    look(first["lo"], first["hi"], 0, sorted({int(w) for w in wanted} | {min(n - 1, int(w) + 1) for w in wanted}))
    out = [found[int(w)] + (w - int(w)) * (found[min(n - 1, int(w) + 1)] - found[int(w)]) for w in wanted]
    return spark.createDataFrame([(out,)], "q array<double>")


def quantile_classes(df: DataFrame, column: str, classes: Sequence[float], out: str) -> DataFrame:
    """Right-closed bins between equally spaced quantiles (the lowest included), valued as given."""
    n = len(classes)
    q = quantiles(df, column, [k / n for k in range(1, n)])
    value = F.lit(float(classes[-1]))
    for k in reversed(range(n - 1)):
        value = F.when(F.col(column) <= F.element_at("_q", k + 1), float(classes[k])).otherwise(value)
    return df.join(F.broadcast(q.withColumnRenamed("q", "_q"))).withColumn(out, F.when(F.col(column).isNotNull(), value)).drop("_q")


def knee(df: DataFrame, x: str, y: str) -> DataFrame:
    """The row farthest from the chord between the first and the last point (by x)."""
    ends = df.agg(F.min_by(F.struct(x, y), x).alias("a"), F.max_by(F.struct(x, y), x).alias("b"))
    dx, dy = F.col("b")[x] - F.col("a")[x], F.col("b")[y] - F.col("a")[y]
    off = F.abs(dy * (F.col(x) - F.col("a")[x]) - dx * (F.col(y) - F.col("a")[y])) / F.sqrt(dx * dx + dy * dy)
    scored = df.join(F.broadcast(ends)).withColumn("_off", off)
    return scored.agg(F.max_by(F.struct(*df.columns), F.struct(F.col("_off"), -F.col(x))).alias("k"), F.max("_off").alias("distance")).select("k.*", "distance")


def welch(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row for two groups a < b: t and degrees of freedom of Welch's test."""
    each = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    a = each.select(F.col(group).alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("v").alias("va"))
    b = each.select(F.col(group).alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("v").alias("vb"))
    s, t = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", ((F.col("ma") - F.col("mb")) / F.sqrt(s + t)).alias("t"), ((s + t) * (s + t) / (s * s / (F.col("na") - 1) + t * t / (F.col("nb") - 1))).alias("df"))


def _beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    import math

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d), 1 + term / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    """Chance of a t at least as far from 0."""
    return _beta_share(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    """The t below which a share ``p`` above a half of the distribution lies, by halving."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - t_two_sided(middle, df) / 2 < p else (low, middle)
    return (low + high) / 2


def welch_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """``welch`` with its two-sided p; one row, so the distribution is worked out on the driver."""
    found = welch(df, group, value).limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"{group} has more than two groups")
    rows = [(r["a"], r["b"], r["t"], r["df"], t_two_sided(r["t"], r["df"])) for r in found]
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"a {kind}, b {kind}, t double, df double, p double")


class LinearModel:
    """Least squares of y on several columns, from one pass of sums of products."""

    def __init__(self, df: DataFrame, y: str, xs: Sequence[str]):
        import numpy as np

        self.xs = list(xs)
        names = ["_one", *self.xs, "_y"]
        rows = df.select(F.lit(1.0).alias("_one"), *[F.col(x).cast("double").alias(x) for x in self.xs], F.col(y).cast("double").alias("_y")).dropna()
        sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
        m = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
        self.n, k = int(m[0, 0]), len(self.xs) + 1
        if self.n <= k:
            raise ValueError("too few complete rows")
        self.inverse = np.linalg.inv(m[:k, :k])
        self.b = self.inverse @ m[:k, k]
        self.df = self.n - k
        self.s2 = max(0.0, float(m[k, k] - self.b @ m[:k, k])) / self.df
        self.r2 = 1 - self.s2 * self.df / float(m[k, k] - m[0, k] ** 2 / self.n)

    def table(self, spark) -> DataFrame:
        """(term, estimate, se, t, p)."""
        se = [float((self.s2 * self.inverse[i, i]) ** 0.5) for i in range(len(self.b))]
        rows = [(name, float(b), s, float(b) / s if s else None, t_two_sided(float(b) / s, self.df) if s else None) for name, b, s in zip(["(intercept)", *self.xs], self.b, se, strict=True)]
        return spark.createDataFrame(rows, "term string, estimate double, se double, t double, p double")

    def predict(self, df: DataFrame, level: float = 0.95) -> DataFrame:
        """``df`` with fit, lower and upper: the bounds between which a new observation lies with that chance."""
        x = [F.lit(1.0), *[F.col(c).cast("double") for c in self.xs]]
        fit = sum((F.lit(float(b)) * c for b, c in zip(self.b[1:], x[1:], strict=True)), F.lit(float(self.b[0])))
        spread = sum((F.lit(float(self.inverse[i, j])) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))), F.lit(1.0))
        half = F.lit(t_quantile(0.5 + level / 2, self.df)) * F.sqrt(F.lit(self.s2) * spread)
        return df.withColumn("fit", fit).withColumn("lower", fit - half).withColumn("upper", fit + half)


def predict_chunks(df: DataFrame, model, columns: Sequence[str], out: str = "score", rows: int = 10_000) -> DataFrame:
    """``df`` with the scores that ``model`` (pandas table -> numbers) gives, in chunks of at most ``rows``; nulls go in as they are."""
    from pyspark.sql import types as T

    columns, kept = list(columns), df.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield part.append_column(out, pa.array([float(v) for v in model(part.select(columns).to_pandas())], pa.float64()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])).select(*kept, out)


def permutation_importance(df: DataFrame, model, columns: Sequence[str], observed: str, id: str, rounds: int = 10, seed: int = 1) -> DataFrame:
    """(variable, importance): mean fall of the AUC over ``rounds`` shuffles of one column's values among the rows.

    A shuffle gives each row the value of the row that a second hash order puts
    in its place; both orders are numbered over ranges, not in one task.
    """
    from thalweg.operators.tables import row_numbers

    spark = df.sparkSession
    score = lambda t: auc(predict_chunks(t, model, columns).select(F.col(observed).alias("observed"), "score")).first()["auc"]
    base, out = score(df), []
    for c in columns:
        falls = []
        for k in range(rounds):
            order = lambda s: F.xxhash64(F.lit(seed * 1000 + 2 * k + s), F.col(id))  # noqa: B023, E731
            own = row_numbers(df.withColumn("_o", order(0)), ["_o", id]).drop("_o", c)
            other = row_numbers(df.select(id, c).withColumn("_o", order(1)), ["_o", id]).select("row_no", c)
            falls.append(base - score(own.join(other, "row_no").select(*df.columns)))
        out.append((c, float(sum(falls) / len(falls))))
    return spark.createDataFrame(out, "variable string, importance double")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, r2, n of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def forest(train: DataFrame, predictors: Sequence[str], observed: str = "observed", trees: int = 100, seed: int = 1):
    """A random forest whose presences and absences weigh alike."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n = train.agg(F.count_if(F.col(observed) == 1).alias("p"), F.count_if(F.col(observed) == 0).alias("a")).first()
    data = VectorAssembler(inputCols=list(predictors), outputCol="_x").transform(train.dropna(subset=list(predictors)).withColumn("_y", F.col(observed).cast("double")).withColumn("_w", F.when(F.col(observed) == 1, 1.0).otherwise(n["p"] / max(1, n["a"]))))
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, seed=seed).fit(data)
