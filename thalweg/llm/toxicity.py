"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import alnum_words, crc_mod, map_arrow, materialize, text_rows
from thalweg.llm.vectors import float_sums


def features_of(text: str) -> set[bytes]:
    """Words and, for longer ones, their beginnings of 4, 5 and 6 bytes (marked by a leading ``^``)."""
    words = set(alnum_words(text))
    out = set(words)
    for n in (4, 5, 6):
        out.update([b"^" + w[:n] for w in words if len(w) > n])
    return out


def strengths(text: str, known: dict[int, dict[bytes, int]], dense: float = 0.004) -> dict[int, float]:
    """How strongly each known feature stands in a text: {place: value in (0, 1]}.

    A feature has full strength if it makes up ``dense`` of the words, and in
    short texts if it occurs at all; single words of long texts hardly count.
    ``known`` has the places by the length of the beginning, 0 for whole words.
    """
    words = alnum_words(text)
    seen = set(words)
    most = max(1.0, dense * len(words))
    out = {}
    for n, places in known.items():
        if n == 0:
            for f in places.keys() & seen:
                out[places[f]] = min(1.0, words.count(f) / most)
        else:
            found = places.keys() & {w[:n] for w in seen if len(w) > n}
            for f in found:
                out[places[f]] = min(1.0, sum(len(w) > n and w.startswith(f) for w in words) / most)
    return out


def places_of(text: str, known: dict[int, dict[bytes, int]]) -> set[int]:
    """Places of the known features that a text has."""
    seen = set(alnum_words(text))
    out: set[int] = set()
    for n, places in known.items():
        found = places.keys() & (seen if n == 0 else {w[:n] for w in seen if len(w) > n})
        out.update(places[f] for f in found)
    return out


def by_length(names: list[bytes]) -> dict[int, dict[bytes, int]]:
    """Places of the features by the length of the beginning that they stand for, 0 for whole words."""
    out: dict[int, dict[bytes, int]] = {}
    for k, f in enumerate(names):
        out.setdefault(len(f) - 1 if f[:1] == b"^" else 0, {})[f[1:] if f[:1] == b"^" else f] = k
    return out


def _with_bias(x: np.ndarray) -> np.ndarray:
    """Rows as doubles (bytes as shares of 255) with a last column of ones."""
    out = np.ones((len(x), x.shape[1] + 1))
    np.divide(x, 255 if x.dtype == np.uint8 else 1, out=out[:, :-1], casting="unsafe")
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def negative_sums(x: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of rows x that each stand for n: summed loss of the answer no, its gradient and the upper half of its second derivative."""
    g = x @ w
    p = _sigmoid(g)
    second = (x.T * (n * p * (1 - p))) @ x
    return np.concatenate([[n @ np.logaddexp(0, g)], x.T @ (n * p), second[np.triu_indices(len(w))]])


def minimum(positive: np.ndarray, sums: Callable[[np.ndarray], np.ndarray], n: float, prior: float, decay: float, soft: float = 1e-2, most: int = 60) -> np.ndarray:
    """Weights (bias last) at which the non-negative positive-unlabelled risk of a linear classifier is smallest.

    With a logistic loss l the risk is A + max(0, N) for A = prior * E_p[l(g)]
    and N = E_u[l(-g)] - prior * E_p[l(-g)]. Both A and A + N are convex in the
    weights, so the greater of the two is; the corner is rounded (``soft``) by
    log(exp(A) + exp(A + N)), convex as well, and with a quadratic penalty there
    is one minimum, which Newton steps find. ``sums(w)`` gives ``negative_sums``
    over all unlabelled rows, ``n`` of them.
    """
    p = _with_bias(positive)
    w, size = np.zeros(p.shape[1]), p.shape[1]
    penalty = np.full(size, decay)
    penalty[-1] = 1e-3 * decay
    upper = np.triu_indices(size)

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        out = sums(w) / n
        h = np.zeros((size, size))
        h[upper] = out[size + 1 :]
        h = h + np.triu(h, 1).T
        g = p @ w
        s = _sigmoid(g)
        a, ga = prior * np.logaddexp(0, -g).mean(), -prior * (p.T @ (1 - s)) / len(p)
        ha = prior * ((p.T * (s * (1 - s))) @ p) / len(p)
        gap, gn, hn = out[0] - prior * np.logaddexp(0, g).mean(), out[1 : size + 1] - prior * (p.T @ s) / len(p), h - ha
        share = float(_sigmoid(np.array(gap / soft)))
        value = a + soft * np.logaddexp(0, gap / soft) + 0.5 * (penalty * w) @ w
        return value, ga + share * gn + penalty * w, ha + share * hn + share * (1 - share) / soft * np.outer(gn, gn) + np.diag(penalty)

    value, gradient, second = look(w)
    for _ in range(most):
        step = np.linalg.solve(second, gradient)
        size_of = float(np.abs(step).max())
        for _ in range(30):
            then = look(w - step)
            if then[0] <= value + 1e-12:
                break
            step = step / 2
        w, (value, gradient, second) = w - step, then
        if size_of < 1e-7:  # the next step would be its square
            break
    return w


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = 1e-4) -> np.ndarray:
    """Weights (bias last) from unlabelled rows at hand."""
    u = _with_bias(unlabelled)
    return minimum(positive, lambda w: negative_sums(u, np.ones(len(u)), w), len(u), prior, decay)


#: A feature's place and its strength in 255ths.
_PLACE = np.dtype([("at", "<u2"), ("v", "u1")])


def _sparse(text: str, known: dict[int, dict[bytes, int]]) -> bytes:
    found = [(k, round(255 * v)) for k, v in sorted(strengths(text, known).items())]
    return np.array([f for f in found if f[1]], _PLACE).tobytes()


def _dense(rows: list[bytes], size: int) -> np.ndarray:
    x = np.zeros((len(rows), size), np.uint8)
    found = np.frombuffer(b"".join(rows), _PLACE)
    x[np.repeat(np.arange(len(rows)), [len(r) // _PLACE.itemsize for r in rows]), found["at"]] = found["v"]
    return x


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, pool: int = 20_000, size: int = 512, fold: int = 5, held: int = 0) -> tuple[dict[bytes, float], float]:
    """A model {feature: weight}, bias from rows whose crc32(doc_id) mod ``fold`` is not ``held``.

    Confirmed toxic texts are a bounded sample: at most ``positives`` rows, by a
    hash of doc_id. The unlabelled texts are all rows outside the held-out
    fold: their features are counted in one pass, another finds their vectors,
    of which equal ones are counted together, and each step of the fit sums over
    all of those. So there is one model, and neither partitions nor their order
    change it beyond rounding. Features: those of three toxic texts or more (the
    ``pool`` most frequent) that are more frequent there than in the unlabelled
    texts, at most ``size``; equal ranks go by their bytes. The penalty on the
    weights narrows with the square of the sample (2.5 / n**2, 2e-6 at least).
    The class prior is the toxic share of all labelled rows outside the fold, or
    less if features frequent in toxic texts are rarer among the unlabelled than
    that. Without any toxic or any unlabelled row the model is a
    constant.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    prior = usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    rows = text_rows(docs).where(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != held))
    ids = usable.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id")
    sample = materialize(rows.join(F.broadcast(ids), "doc_id"), "toxic-sample")  # bounded by ``positives``
    n_p, n_u = sample.count(), rows.count()
    if not n_p or not n_u or prior <= 0:
        return {}, -5.0
    if prior >= 1:
        return {}, 5.0

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = Counter(f for text in batch.column("text").to_pylist() for f in features_of(text))
        return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["feature", "p"])

    frequent = map_arrow(sample, counts, "feature binary, p long").groupBy("feature").agg(F.sum("p").alias("p")).where("p >= 3")
    pooled = {bytes(r["feature"]): r["p"] for r in frequent.orderBy(F.desc("p"), "feature").limit(pool).collect()}
    if not pooled:
        return {}, float(np.log(prior / (1 - prior)))
    names = list(pooled)
    shared = spark.sparkContext.broadcast(by_length(names))

    def among(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = np.zeros(len(names), np.int64)
        for text in batch.column("text").to_pylist():
            seen[list(places_of(text, shared.value))] += 1
        at = np.flatnonzero(seen)
        return pa.record_batch([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["at", "u"])

    u = {r["at"]: r["u"] for r in map_arrow(rows.select("text"), among, "at long, u long").groupBy("at").agg(F.sum("u").alias("u")).collect()}  # at most ``pool`` rows
    # no feature can be more than 1 / prior times as frequent in toxic as in all texts; one far below that says little,
    # and many such would add up in long texts
    # no feature can be rarer in all texts than prior times its share in toxic ones: the rarest bound the prior
    ratios = sorted(u.get(at, 0) / n_u / (pooled[f] / n_p) for at, f in enumerate(names) if pooled[f] >= max(10, 0.05 * n_p))
    prior = min(prior, *ratios[2:3], 0.999) if len(ratios) > 2 and ratios[2] > 0 else prior
    lift, ranked = 1 + 0.25 * (1 / prior - 1), []
    for at, f in enumerate(names):
        share_p, share_u = pooled[f] / n_p, u.get(at, 0) / n_u
        both = (pooled[f] + u.get(at, 0)) / (n_p + n_u)
        z = (share_p - share_u) / math.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
        if z > 3.7 and share_p >= lift * share_u:
            ranked.append((-z, f))
    names = [f for _, f in sorted(ranked)[:size]]
    if not names:
        return {}, float(np.log(prior / (1 - prior)))
    known = by_length(names)

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array([_sparse(t, known) for t in batch.column("text").to_pylist()], pa.binary())], names=["x"])

    toxic = sorted(bytes(r["x"]) for r in map_arrow(sample.select("text"), vectors, "x binary").collect())  # three bytes a feature for each of ``positives`` rows
    counted = materialize(map_arrow(rows.select("text"), vectors, "x binary").groupBy("x").agg(F.count("*").alias("n")), "vectors")

    def look(batch: pa.RecordBatch, w: np.ndarray) -> np.ndarray:
        return negative_sums(_with_bias(_dense(batch.column("x").to_pylist(), len(names))), batch.column("n").to_numpy().astype(float), w)

    w = minimum(_dense(toxic, len(names)), lambda w: float_sums(counted, look, w), n_u, prior, max(2e-6, 2.5 / n_p**2))
    return {f: float(w[k]) for k, f in enumerate(names)}, float(w[-1])


def score_toxicity(docs: DataFrame, model: tuple[dict[bytes, float], float], keep: tuple[str, ...] = (), fold: int = 5, held: int = 0) -> DataFrame:
    """Score every whole text: doc_id, held_out, score in (0, 1), predicted (score >= 0.5).

    With ``keep`` these columns of ``docs`` are carried along and the results
    are named _doc_id, _held_out, _score, _predicted.
    One row for each input row, repeated rows included and with equal scores, no
    shuffle; a null or empty text gets the score of no feature at all, an empty
    table gives no rows. A score of exactly 0.5 counts as toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``size`` features

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, bias = shared.value
        names = list(weights)
        known, values = by_length(names), []
        for text in batch.column("_text").to_pylist():
            g = bias + sum(weights[names[k]] * v for k, v in strengths(text, known).items())
            values.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, g))))))
        kept = [c for c in batch.schema.names if c.startswith("_keep_")]
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32()), *(batch.column(c) for c in kept)], names=["doc_id", "held_out", "score", "predicted", *kept])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), fold) == held).alias("held_out"), F.coalesce("text", F.lit("")).alias("_text"), *[F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)])
    schema = ", ".join(["doc_id long, held_out boolean, score double, predicted int", *(f"_keep_{k} {rows.schema[f'_keep_{k}'].dataType.simpleString()}" for k in range(len(keep)))])
    own = ["doc_id", "held_out", "score", "predicted"]
    return map_arrow(rows, score, schema, most_bytes=4 << 20).select(*[F.col(c).alias(f"_{c}" if keep else c) for c in own], *[F.col(f"_keep_{k}").alias(c) for k, c in enumerate(keep)])
