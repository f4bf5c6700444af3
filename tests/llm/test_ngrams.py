"""The n-gram join against all pairs, its search against counting, odd inputs of every kind."""

import random
from collections import Counter

import numpy as np
import pytest
from test_operators import exact_components, table

from thalweg.llm import ngrams as N


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghilmnorstuéß") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.mark.parametrize(("block", "width", "share"), [(512, 4, 85), (4, 4, 85), (8, 1, 60)])
def test_against_all_pairs(spark, words, block, width, share):
    rng = random.Random(11)
    rows, k = [], 0
    passage = [rng.choice(words) for _ in range(25)]
    for _ in range(14):
        base = [rng.choice(words) for _ in range(rng.randint(5, 110))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.2:
                copy[2:2] = passage
            rows.append((k * 13 % 997, " ".join(copy)))
            k += 1
    rows += [(2000, None), (2001, ""), (2002, "One"), (2003, "one"), (2004, "one two"), (2005, " \n "), (None, rows[0][1]), rows[3], (rows[0][0], "quite another text of six words")]
    docs = table(spark, rows)
    got = Counter(map(tuple, N.ngram_join(docs.repartition(1 + width), width, share, block).collect()))
    assert got == exact_components(rows, width, share)


def test_no_rows_and_nothing_but_odd_rows(spark):
    assert N.ngram_join(table(spark, []), 4, 85).collect() == []
    got = N.ngram_join(table(spark, [(1, None), (2, ""), (None, None), (None, "a b c d e"), (None, "a b c d e")]), 4, 85).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True), (None, 2, None, True), (None, 2, None, True)], key=str)


def test_a_large_cluster_and_a_shared_passage(spark, words):
    rng = random.Random(41)
    base, passage = [rng.choice(words) for _ in range(150)], [rng.choice(words) for _ in range(60)]
    rows = []
    for k in range(500):
        copy = list(base)
        copy[rng.randrange(150)] = rng.choice(words)
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(40)) + " " + " ".join(passage)) for k in range(300)]
    got = Counter(map(tuple, N.ngram_join(table(spark, rows).repartition(6), 4, 85, 64).collect()))
    assert got == exact_components(rows, 4, 85)


def test_a_very_long_text(spark, words):
    rng = random.Random(43)
    long = [rng.choice(words) for _ in range(60_000)]
    near = list(long)
    for k in range(0, 60_000, 120):
        near[k] = "changed"
    rows = [(7, " ".join(long)), (3, " ".join(near)), (5, " ".join(long[:40_000]))]
    got = {r["doc_id"]: r["component_id"] for r in N.ngram_join(table(spark, rows), 4, 85).collect()}
    assert got == {7: 3, 3: 3, 5: 5}


def test_the_search_against_counting():
    rng = random.Random(5)
    for size in (3, 40, 300):
        common = [rng.getrandbits(62) for _ in range(size * 2)]
        sets = []
        for _ in range(60):
            own = set(rng.sample(common, size // rng.choice([1, 2, 3]))) | {rng.getrandbits(62) for _ in range(rng.randrange(size))}
            sets.append(np.array(sorted(own), np.int64))
        lists = N.Lists(sets)
        for x in range(0, 60, 7):
            alive = np.array([rng.random() < 0.8 for _ in sets])
            alive[x] = False
            for t in (1, 2, size // 3 + 1, size):
                found, counts = lists.search(x, t, alive)
                want = {y: c for y, s in enumerate(sets) if alive[y] and (c := len(np.intersect1d(s, sets[x]))) >= t}
                assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == want


def test_marks_bound_the_overlap():
    rng = np.random.default_rng(7)
    far = 0
    for n, m in ((1, 1), (5, 6), (8, 9), (33, 31), (300, 330), (510, 515), (4000, 4200)):
        for share in (60, 85, 100):
            common = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            for kept in (n, int(0.97 * n), int(0.8 * n), n // 2, 0):
                other = np.unique(np.concatenate([common[:kept], rng.integers(0, 2**64, max(1, m - kept), dtype=np.uint64)]))
                linked = 100 * len(np.intersect1d(common, other)) >= share * len(np.union1d(common, other))
                found = bool(N.bound_kernel(share)([[1, 2], [0, 0], [1, 2], [len(common), len(other)], [N.marks(x).tobytes() for x in (common, other)]]))
                assert found or not linked
                far += n > 200 and kept <= n // 2 and found and share > 80
    assert far == 0  # and pairs far from the threshold are not candidates
    hot = np.arange(400, dtype=np.uint64)  # all in one range
    assert N.bound_kernel(90)([[1, 2], [0, 0], [1, 2], [400, 390], [N.marks(x).tobytes() for x in (hot, hot[:390])]]) == [(0, 1)]


def test_linked_sets_share_enough_of_what_they_post():
    rng = random.Random(6)
    for share in (80, 85, 100):
        for _ in range(800):
            n = rng.randint(1, 260)
            own = sorted(rng.getrandbits(40) for _ in range(n))
            other = sorted(set(rng.sample(own, rng.randint(N.least(n, share), n))) | {rng.getrandbits(40) for _ in range(rng.randint(0, n // 5))})
            common = len(set(own) & set(other))
            assert (common >= N.overlap(n, len(other), share)) == (100 * common >= share * len(set(own) | set(other)))
            if common >= N.overlap(n, len(other), share):
                got = len(set(own[: N.posted(n, share)]) & set(other[: N.posted(len(other), share)]))
                assert got >= min(N.spare(n), N.spare(len(other))) >= max(N.spare(N.least(n, share)), N.spare(N.least(len(other), share)))
                assert len(other) >= N.least(n, share) and common >= N.least(n, share)


def test_postings_are_shuffled_by_their_key_once(spark, monkeypatch):
    from thalweg.llm import ngrams

    plans = {}

    def look(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(ngrams, "materialize", look)
    classes = spark.createDataFrame([(1, 3, [5, 6, 7]), (2, 3, [5, 6, 8]), (3, 3, [9, 10, 11])], "node long, n long, posted array<bigint>")
    assert {r["node"] for r in ngrams._lists_of(classes, 85).collect()} == {1, 2}
    assert plans["lists"].count("Exchange hashpartitioning(key") == 1
