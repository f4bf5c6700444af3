"""Maximum entropy models of presences against background: hinge and product features, a penalised fit over summed derivatives.

The fit is the infinitely weighted logistic regression that the method comes
down to: presences weigh 1, background rows ``background`` each, and every
feature has an absolute penalty of its own. Each outer step sums the first and
second derivatives over all rows, partition by partition, and the penalised
quadratic they give is solved on the driver (its size is that of the features);
so the model is the same for every partitioning but for rounding. Features are
column expressions, so predictions stay in whole-stage code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.plans.scratch import materialize, partitions


@dataclass
class Maxent:
    """Ranges of the variables, features (kind, variables, knot) with their weights, and what scales the response."""

    ranges: dict[str, tuple[float, float]]
    features: list[tuple]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    alpha: float = 0.0
    entropy: float = 0.0
    steps: int = 0


def _scaled(ranges: dict[str, tuple[float, float]], name: str) -> Column:
    """The variable as a share of its range, held at its ends beyond it."""
    low, high = ranges[name]
    x = F.col(name).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def feature(ranges: dict[str, tuple[float, float]], what: tuple) -> Column:
    """A feature as a column between 0 and 1."""
    kind, names, knot = what
    x = _scaled(ranges, names[0])
    if kind == "linear":
        return x
    if kind == "quadratic":
        return x * x
    if kind == "product":
        return x * _scaled(ranges, names[1])
    if kind == "rise":
        return F.greatest(F.lit(0.0), (x - knot) / (1 - knot))
    return F.greatest(F.lit(0.0), (knot - x) / knot)


def _sums(rows: DataFrame, look: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of ``look(features, observed, weights)`` over all rows: in each partition, then in one small task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                one = look(x, batch.column("y").to_numpy(), batch.column("w").to_numpy())
                total = one if total is None else total + one
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total = np.frombuffer(v) + (0 if total is None else total)
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["v"])

    first = rows.mapInArrow(part, "v binary").repartition(max(1, partitions(rows.sparkSession) // 4)).mapInArrow(unite, "v binary")
    got = [np.frombuffer(r["v"]) for r in first.coalesce(1).mapInArrow(unite, "v binary").collect()]
    return got[0] if got else np.zeros(0)


def _quadratic(gradient: np.ndarray, second: np.ndarray, at: np.ndarray, penalty: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The minimum of the quadratic around ``at`` plus the absolute penalties, by coordinates."""
    w, slope = at.copy(), gradient.copy()
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            z = second[j, j] * w[j] - slope[j]
            new = np.sign(z) * max(0.0, abs(z) - penalty[j]) / second[j, j]
            if new != w[j]:
                slope += second[:, j] * (new - w[j])
                most, w[j] = max(most, abs(new - w[j])), new
        if most < 1e-12:
            break
    return w


def fit_maxent(df: DataFrame, observed: str, columns: Sequence[str], knots: int = 5, products: bool = True, multiplier: float = 1.0, background: float = 100.0, steps: int = 40, tolerance: float = 1e-9) -> Maxent:
    """A model of rows with ``observed`` 1 (presence) against those with 0 (background).

    Rows with a null in any of the columns are left out, variables that do not
    vary give no feature. For each variable: linear, quadratic, ``knots`` rising
    and falling hinges; for each two their product. A feature's penalty is
    ``multiplier`` times its spread among the presences over the root of their
    number (a tenth of that root at least). Without presences or background
    there is nothing to fit: ValueError.
    """
    good = df.where(F.col(observed).isin(0, 1)).dropna(subset=[observed, *columns])
    row = good.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))], F.count_if(F.col(observed) == 1).alias("n"), F.count("*").alias("all")).first()
    n = row["n"]
    if not n or n == row["all"]:
        raise ValueError("presences and background are both needed")
    ranges = {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns if row[f"lo_{c}"] < row[f"hi_{c}"]}
    at = [(k + 1) / (knots + 1) for k in range(knots)]
    features = [(kind, (c,), None) for c in ranges for kind in ("linear", "quadratic")] + [(kind, (c,), k) for c in ranges for k in at for kind in ("rise", "fall")]
    features += [("product", pair, None) for pair in combinations(ranges, 2)] if products else []
    model = Maxent(ranges, features, np.zeros(len(features)))
    y = F.col(observed).cast("double")
    x = F.array(*[feature(ranges, f) for f in features]) if features else F.array().cast("array<double>")
    rows = materialize(good.select(x.alias("x"), y.alias("y"), F.when(y == 1, 1.0).otherwise(background).alias("w")), "maxent-features")
    k = len(features) + 1
    if features:
        spread = _sums(rows, lambda x, y, w: np.concatenate([x[y == 1].sum(axis=0), (x[y == 1] ** 2).sum(axis=0)])) / n
        sd = np.sqrt(np.maximum(0, spread[k - 1 :] - spread[: k - 1] ** 2))
        penalty = np.append(multiplier * np.maximum(sd, 0.1) / np.sqrt(n), 0.0)
        upper = np.triu_indices(k)

        def look(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def one(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
                x = np.hstack([x, np.ones((len(x), 1))])
                g = x @ v
                p = 0.5 * (1 + np.tanh(g / 2))
                return np.concatenate([[w @ (np.logaddexp(0, g) - y * g)], x.T @ (w * (p - y)), ((x.T * (w * p * (1 - p))) @ x)[upper]])

            out = _sums(rows, one) / n
            h = np.zeros((k, k))
            h[upper] = out[k + 1 :]
            return out[0] + penalty @ np.abs(v), out[1 : k + 1], h + np.triu(h, 1).T + 1e-9 * np.eye(k)

        v = np.append(np.zeros(k - 1), -np.log(background * (row["all"] - n) / n))
        value, gradient, second = look(v)
        for _ in range(steps):
            model.steps += 1
            way, then = _quadratic(gradient, second, v, penalty) - v, None
            for _ in range(30):
                then = look(v + way)
                if then[0] <= value + 1e-13:
                    break
                way = way / 2
            v, moved = v + way, float(np.abs(way).max())
            value, gradient, second = then
            if moved < tolerance:
                break
        model.weights, model.intercept = v[:-1], float(v[-1])
    f = linear(model)
    ground = good.where(F.col(observed) == 0)
    top = ground.agg(F.max(f)).first()[0]
    mass = ground.agg(F.sum(F.exp(f - top)).alias("z"), F.sum(F.exp(f - top) * (f - top)).alias("zf")).first()
    # raw shares sum to one over the background; their entropy scales the response
    model.alpha, model.entropy = -(top + float(np.log(mass["z"]))), float(np.log(mass["z"]) - mass["zf"] / mass["z"])
    return model


def linear(model: Maxent) -> Column:
    """The exponent, of the features that have a weight."""
    out = F.lit(0.0)
    for f, w in zip(model.features, model.weights, strict=True):
        if w:
            out = out + F.lit(float(w)) * feature(model.ranges, f)
    return out


def predict_maxent(df: DataFrame, model: Maxent, kind: str = "cloglog", name: str = "suitability") -> DataFrame:
    """``df`` with the response: ``cloglog`` or ``logistic`` between 0 and 1, ``raw`` (share of the background) or ``link``; null where a variable is."""
    f = linear(model)
    known = [F.col(c).isNotNull() for c in model.ranges]
    score = {
        "link": lambda: f,
        "raw": lambda: F.exp(f + model.alpha),
        "cloglog": lambda: 1 - F.exp(-F.exp(f + model.alpha + model.entropy)),
        "logistic": lambda: 1 / (1 + F.exp(-(f + model.alpha + model.entropy))),
    }[kind]()
    here = known[0] if known else F.lit(True)
    for c in known[1:]:
        here = here & c
    return df.withColumn(name, F.when(here, score))
