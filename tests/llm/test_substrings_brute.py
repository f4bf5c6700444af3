"""Repeated substrings against a byte-by-byte version."""

import hashlib
import random
from collections import Counter

import pytest

from thalweg.llm.substrings import remove_repeats, spans_and_rest


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(20) for _ in range(3)]
    texts = [prose(rng.randint(1, 60)) for _ in range(12)]
    for _ in range(12):
        texts.append(prose(rng.randint(0, 20)) + rng.choice(shared)[rng.randint(0, 9) :] + prose(rng.randint(0, 20)))
    texts += [texts[0], texts[0], "ab" * 90, "xyz" * 40 + "ab" * 60, "", None, "short"]
    return texts


@pytest.mark.parametrize("bucket", [8192, 2])
def test_against_brute_force(spark, bucket):
    texts = corpus(bucket)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, name string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs, 40, 12, bucket).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 40)
    assert sum(g[1] for g in got.values()) > 0


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "".join(chr(97 + (k * k) % 23) for k in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + "z"), (2, "other")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(docs, 40, 12).collect())
    assert got == [(0, 60), (1, 60), (1, 60), (2, 0)]
    assert remove_repeats(docs.limit(0), 40, 12).collect() == []


def test_contract_length_on_real_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900_000, rows[0][1] and rows[0][1] * 3), (900_001, None), (900_002, (rows[1][1] or "") + (rows[2][1] or ""))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs, 400).collect()}
    assert [got[d] for d, _ in rows] == brute([t for _, t in rows], 400)
    assert sum(g[1] for g in got.values()) > 0


def thue_morse(n, zero, one):
    return "".join(one if bin(k).count("1") % 2 else zero for k in range(n))


@pytest.mark.parametrize("n", [512, 1024])
def test_strings_with_equal_polynomials_are_not_equal(spark, n):
    texts = [thue_morse(n, "a", "b"), thue_morse(n, "b", "a"), thue_morse(n, chr(111), chr(27)), thue_morse(n, chr(27), chr(111))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in remove_repeats(docs, n).collect())


@pytest.mark.parametrize("bucket", [8192, 3])
def test_long_texts_and_columns_that_clash(spark, bucket):
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = line(900)
    texts = [line(150_000) + shared + line(40_000), shared[:500] + line(30), line(200) + shared[300:], shared[100:700], "z" * 3000]
    docs = spark.createDataFrame([(k, t, 1, b"x", [2], "n", 3, 4) for k, t in enumerate(texts)], "doc_id long, text string, name int, key binary, found array<int>, sha string, size int, n_bytes int")
    out, rest = spans_and_rest(docs, 400, 120, bucket)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 400)
    kept = {bytes(r["key"]): bytes(r["kept"]) for r in rest.collect()}
    assert {hashlib.sha256(x).hexdigest() for x in kept.values()} == {g[3] for g in got.values() if g[1]}


def test_many_equal_rows_cost_what_one_does(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh é") for _ in range(20_000))
    docs = spark.range(2000).selectExpr("cast(7 as long) as doc_id", f"'{text}' as text").unionByName(spark.createDataFrame([(None, text), (8, text[:1000] + "x")], "doc_id long, text string"))
    got = Counter((r["doc_id"], r["n_removed"], r["n_spans"]) for r in remove_repeats(docs).collect())
    n = len(text.encode())
    assert got == {(7, n, 1): 2000, (None, n, 1): 1, (8, len(text[:1000].encode()), 1): 1}
