"""Centroid clustering and whitening against brute force in exact or plain dense arithmetic; odd inputs of every kind."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import centroids as C
from thalweg.llm import vectors as V
from thalweg.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, x int, n long"


def table(spark, rows):
    """Vectors with columns that clash with results' names."""
    return spark.createDataFrame([(i, v, 1, "c", 7, 0) for i, v in rows], SCHEMA)


def odd_rows(size):
    """Rows that no operator may keep."""
    one = [0.5] * size
    return [(9000, None), (9001, [None, *one[1:]]), (9002, [float("nan"), *one[1:]]), (9003, [*one[1:], float("-inf")]), (9004, [])]


def normal(seed, n, size, spread=None):
    x = np.random.default_rng(seed).standard_normal((n, size)) * (1 if spread is None else spread)
    return [(k * 7 % 10007, [float(v) for v in row.astype(np.float32)]) for k, row in enumerate(x)]


def lloyd(rows, k, rounds, size, scale):
    """The contract in Python's integers."""
    kept = [(i, [min(max(math.floor(scale * c), -(2**63)), 2**63 - 1) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    pick = lambda x: min(range(len(centroids)), key=lambda c: (far(x, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(pick(x), []).append(x)
        centroids = [[sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(centroids)]
    most = 2**63 - 1
    found = [(i, c := pick(x), min(most, far(x, centroids[c]))) for i, x in kept]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return Counter((i, c, d, min(most, sums[c]), min(most, sum(sums.values())), digest(c)) for i, c, d in found)


def clustered(df, **how):
    return Counter(map(tuple, C.with_inertia(*C.cluster_vectors(df, **how)).collect()))


def test_clusters_of_odd_rows_against_exact_integers(spark):
    rows = normal(1, 300, 8) + odd_rows(8) + [(9005, [1.0] * 7), (9006, [1.0] * 9)]
    rows += [(None, rows[3][1]), (rows[4][0], rows[4][1]), (rows[5][0], rows[6][1]), rows[7], rows[7]]
    want = lloyd(rows, 5, 3, 8, 64)
    for parts in (1, 7):
        assert clustered(table(spark, rows).repartition(parts), k=5, size=8) == want


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(k, [float(k % 3), 0.0]) for k in range(40)]  # equal first centroids: the later ones get nothing
    want = lloyd(rows, 6, 2, 2, 4)
    assert clustered(table(spark, rows), k=6, rounds=2, size=2, scale=4.0) == want
    _, centroids = C.cluster_vectors(table(spark, rows), k=6, rounds=2, size=2, scale=4.0)
    assert len(centroids) == 6 and len({c for _, c, *_ in want}) < 6
    assert C.nearest(np.array([[0, 0], [2, 0]]), np.array([[1, 0], [1, 0], [-1, 0]]))[0].tolist() == [0, 0]


def test_components_beyond_64_bits(spark):
    rows = normal(2, 30, 4) + [(500, [3e38, -3e38, 0.0, 1.0]), (501, [1e12, 0.0, 0.0, 0.0]), (502, [-3e38, 3e38, 0.0, 1.0]), (503, [2e12, 1e10, 0.0, 0.0])]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    assert clustered(table(spark, rows).repartition(3), k=4, size=4) == lloyd(rows, 4, 3, 4, 64)


def test_few_and_no_vectors(spark):
    rows = normal(3, 3, 2)
    assert clustered(table(spark, rows), size=2) == lloyd(rows, 16, 3, 2, 64)
    for nothing in ([], odd_rows(2)):
        assert clustered(table(spark, nothing), size=2) == Counter()
    assert clustered(table(spark, [(k, [0.25, 0.5]) for k in range(50)]), size=2) == lloyd([(k, [0.25, 0.5]) for k in range(50)], 16, 3, 2, 64)


def test_whole_numbers_round_down(spark):
    got = V.whole_rows(table(spark, [(1, [-0.0, -0.001, 0.015625, -0.015625, 1e30, -1e30])]), 64.0).first()["x"]
    assert got == [0, -1, 1, -1, 2**63 - 1, -(2**63)]


def dense(rows, keep, scale):
    """Eigenvectors of the full covariance of the distinct whole vectors."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    x = np.array(sorted({tuple(v) for _, v in kept}))
    n, sums = len(x), x.sum(axis=0)
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return kept, n, sums, x.mean(axis=0), values[::-1][:keep], vectors[:, ::-1][:, :keep], (c * c).sum() / n


def held_to_dense(spark, rows, scale=256.0, extra=(), parts=3):
    kept, n, sums, mean, values, vectors, trace = dense(rows, 4, scale)
    got = W.whiten(table(spark, [*rows, *extra]).repartition(parts), scale=scale).collect()
    k = min(4, len(sums))
    assert len(got) == k * len(kept)
    want = {}
    for i, x in kept:
        want.setdefault(i, []).append((sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True)), (np.array(x) - mean) @ vectors / np.sqrt(values)))
    sign = np.zeros(k)
    for r in got:
        assert r["n"] == n and r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9) and r["identity_error"] < 1e-9
        c = r["component"] - 1
        near = [w for d, w in want[r["vec_id"]] if d == r["deviation"]]
        assert near
        if len(want[r["vec_id"]]) == 1 and abs(near[0][c]) > 1e-3:
            sign[c] = sign[c] or np.sign(r["whitened"] * near[0][c])
            assert r["whitened"] == pytest.approx(sign[c] * near[0][c], abs=1e-8)
    assert (sign != 0).all()


def test_whitening_of_a_steep_and_of_a_flat_spectrum(spark):
    for spread in (0.6 ** np.arange(24), None):
        rows = normal(4, 400, 24, spread)
        again = [(20000, rows[0][1]), (rows[1][0], rows[1][1]), (None, rows[2][1])]
        held_to_dense(spark, [*rows, *again], extra=[*odd_rows(24), (9005, [1.0] * 23)])


def test_narrow_blocks_suffice_for_steep_spectra_and_fill_up_for_flat_ones(spark):
    steep = W.fit_whitening(V.whole_rows(table(spark, normal(5, 300, 30, 0.3 ** np.arange(30))), 2.0**24))
    assert not steep.full and steep.error < 1e-9
    flat = W.fit_whitening(V.whole_rows(table(spark, normal(6, 300, 30)), 256.0))
    assert flat.full and flat.passes < 9 and flat.error < 1e-9


def test_layouts_agree_to_rounding(spark):
    df = V.whole_rows(table(spark, normal(7, 300, 12)), 256.0)
    a, b = (W.fit_whitening(df.repartition(p)) for p in (1, 16))
    assert (a.n, a.sums) == (b.n, b.sums) and np.allclose(a.values, b.values, rtol=1e-12)
    assert np.allclose(np.abs(np.sum(a.components * b.components, axis=0)), 1, atol=1e-12)


def test_whitening_without_variance_with_few_dimensions_and_without_rows(spark):
    got = W.whiten(table(spark, [(k, [0.5, 0.25, 0.125, 0.0, 1.0]) for k in range(9)])).collect()
    assert len(got) == 36 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, 0.0, 0.0, 0.0)}
    held_to_dense(spark, normal(8, 50, 2))
    line = W.whiten(table(spark, [(k, [k / 8, k / 4, 0.0]) for k in range(20)])).collect()  # one direction only
    assert {r["whitened"] for r in line if r["component"] > 1} == {0.0} and max(r["identity_error"] for r in line) < 1e-9
    for nothing in ([], odd_rows(4)):
        assert W.whiten(table(spark, nothing)).collect() == []


def test_deviations_are_exact_or_the_largest_long(spark):
    rng = random.Random(9)
    x = np.array([[rng.randrange(-(2**20), 2**20) for _ in range(4)] for _ in range(5)])
    for n, sums in ((50, [7, -9, 2**40, 0]), (2**20, [2**62, 5, -(2**63), 1])):
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
        assert [int(v) for v in W.deviations(x, n, sums)] == want
        assert V.clamp(W.deviations(x, n, sums)).tolist() == [min(w, 2**63 - 1) for w in want]
    rows = [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [5.0, -1e30])]
    got = W.whiten(table(spark, rows)).select("vec_id", "deviation").distinct().collect()
    assert {r["deviation"] for r in got} == {2**63 - 1}


def test_hot_vectors_count_once(spark):
    rows = normal(10, 60, 6)
    hot = [(30000 + k, rows[0][1]) for k in range(2000)]
    got = W.whiten(table(spark, [*rows, *hot]).repartition(5))
    assert got.select("n").distinct().collect() == [(60,)] and got.count() == 4 * 2060
    assert got.where("component = 1").groupBy(F.round("whitened", 9)).count().agg(F.max("count")).first()[0] == 2001
