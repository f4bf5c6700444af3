"""The training-data operators against brute force, round trips and held-out labels; odd inputs of every kind."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import decontaminate as D
from thalweg.llm import editprint as P
from thalweg.llm import license as LIC
from thalweg.llm import minhash as M
from thalweg.llm import mixing as X
from thalweg.llm import pfor as B
from thalweg.llm import quality as Q
from thalweg.llm import tokens as T
from thalweg.llm import toxicity as TOX

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, text_2 string"


def table(spark, rows):
    """Documents with columns that clash with results' names."""
    return spark.createDataFrame([(d, t, "en", "a", len(t or ""), 0.5, "x") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghilmnorstuéß") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="module")
def texts(words):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [prose(rng.randint(1, 120)) for _ in range(60)]
    out += [out[0], out[0], None, "", " \n\t ", "one", "one two", "A.B,C! 123 \U0001f600 é it's <|endoftext|> x", "long " * 3000, "x" * 5000, out[5] + " tail", "  two  spaces\n\nlines odd　wide "]
    return out


def test_token_counts(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "null id"), (3, texts[3])]
    got = Counter(map(tuple, T.count_tokens(table(spark, rows), T.tokenizer_path("byte_bpe_50k.json"), limit=50, huge=400, overlap=16).collect()))
    lib = T.load(T.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[d, len((t or "").encode()), n, n > 50] += 1
    assert got == want
    assert T.count_tokens(table(spark, []), T.tokenizer_path("byte_bpe_50k.json")).collect() == []


def test_resync_widens_and_equals_whole(words):
    lib = T.load(T.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(8)
    for _ in range(120):
        t = "".join(rng.choice(["a", "b", "É", "×", "…", "́", "²", ".", ",", "!?", " ", "  ", "\n", "é", "'s", "12", ".", "\t", "　", "<|endoftext|>"]) for _ in range(rng.randint(0, 700)))
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert T.resync_count(t, lib, 64, 4) == n
        assert T.direct_count(t, T.PieceEncoder(T.tokenizer_path("byte_bpe_50k.json"), keep=20)) == n
    assert T.resync_count("q" * 3000, lib, 100, 8) == len(lib.encode("q" * 3000, add_special_tokens=False).ids)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_frame_of_reference_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 900, n).astype(np.uint32)
    ids[rng.random(n) < 0.05] = 2**32 - 1
    ids[rng.random(n) < 0.05] = 70000
    starts, body = B.encode_ids(ids)
    assert (B.decode_ids(starts, np.frombuffer(body, np.uint8), n) == ids).all()
    lengths = [0, n // 3, n - n // 3]
    image = B.write_image([5, None, -7], lengths, ids)
    doc_ids, got, back = B.read_image(image)
    assert doc_ids == [5, None, -7] and got.tolist() == lengths and (back == ids).all()
    assert (B.read_document(image, 2) == ids[n // 3 :]).all() and len(B.read_document(image, 0)) == 0


def test_patches_keep_blocks_narrow():
    ids = np.full(12800, 7, np.uint32)
    ids[::128] = 40000  # one outlier a block
    assert len(B.encode_ids(ids)[1]) == 100 * (6 + 5)


def test_token_files(spark, texts, tmp_path):
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts)] + [(None, "null id"), (14, "again")]
    docs = table(spark, rows).repartition(5)
    path = B.write_tokens(docs, T.tokenizer_path("word_bpe_49k.json"), 2, segment_ids=500)
    got = B.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    lib = T.load(T.tokenizer_path("word_bpe_49k.json"))
    at = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    assert [r["doc_id"] for r in got] == [d for d, _ in order]
    for r, (_, t) in zip(got, order, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    names = B.export_files(spark, path, str(tmp_path))
    assert len(names) > 3
    assert sum(B.read_image((tmp_path / n).read_bytes())[1].sum() for n in names) == at
    assert B.token_files(table(spark, []), T.tokenizer_path("word_bpe_49k.json")).collect() == []


def test_a_hot_id_is_dealt_over_several_shards(spark, words):
    rng = random.Random(71)
    rows = [(None, " ".join(rng.choice(words) for _ in range(8))) for _ in range(1500)] + [(None, "equal")] * 1500 + [(k, "one") for k in range(50)]
    path = B.write_tokens(table(spark, rows).repartition(6), T.tokenizer_path("word_bpe_49k.json"), 2)
    shards = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids")).collect()
    assert len(shards) == 4
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in B.read_tokens(spark, path).collect())
    assert len(got) == len(rows) and [g[2] for g in got[:3000]] == [None] * 3000 and [g[2] for g in got[3000:]] == list(range(50))
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def brute_decontamination(text, items, width):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        size = min(width, len(w))
        wins = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(words) - size + 1):
            if wins and tuple(words[k : k + size]) in wins:
                hit.update(range(k, k + size))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_decontamination(spark, texts, words, block):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(12)] + [(50, texts[1]), (51, texts[1]), (50, texts[1]), (60, None), (61, "  "), (None, "none")]
    rows = list(enumerate(texts)) + [(900, "Intro; " + items[3][1].upper() + ", end"), (None, items[4][1]), (0, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in D.decontaminate(table(spark, rows), bench, 5, block).collect())
    assert got == Counter((d, *brute_decontamination(t, [i for i in items if i[0] is not None], 5)) for d, t in rows)
    assert D.decontaminate(table(spark, []), bench).collect() == []
    clean = D.decontaminate(table(spark, rows), bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["contaminated"] for r in clean)


def test_decontamination_spans(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    text = "É. ALPHA, beta--gamma delta"
    r = D.decontaminate(table(spark, [(1, text)]), bench, 13, with_spans=True).first()
    assert [text[s["begin"] : s["end"]] for s in r["spans"]] == ["ALPHA, beta--gamma"]


def test_license_scan(spark, texts):
    rows = list(enumerate(texts)) + [(100, "Under the MIT License. under the mit license"), (101, "Licensed under the Apache License, Version 2.0 you may not use this file except in compliance with the License"), (102, "CC BY-NC"), (103, "This work is licensed under the GNU General Public License, version 3."), (104, "free software gnu"), (None, "cc by nc cc by nc")]
    got = {r["doc_id"]: r for r in LIC.scan_licenses(table(spark, rows)).collect()}
    assert (got[100]["n_base"], got[100]["first_word"], got[100]["last_word"], got[100]["base_labels"]) == (2, 0, 4, "mit")
    assert got[101]["base_labels"] == "apache-2" and "apache-2" in got[101]["labels"]
    assert got[102]["labels"].startswith("cc-by-nc") and got[102]["score"] == 1.0
    assert got[103]["base_labels"] == "" and got[103]["labels"] == "gpl-3" and 0.6 <= got[103]["score"] <= 1
    assert got[104]["labels"] == "" and got[104]["score"] == 0
    assert got[None]["n_base"] == 2 and got[62]["n_words"] == 0 and got[62]["first_word"] is None
    assert LIC.scan_licenses(table(spark, [])).collect() == []


def brute_licenses(words, share, slack):
    """Every begin of every template is tried; a place counts if its word stands near enough."""
    templates = [(label, M_words(t), [M_words(p) for p in must]) for label, t, must in LIC.TEMPLATES + LIC.WHOLE_TEXTS]
    seen = Counter(w for _, t, _ in templates for w in set(t))
    idf = {w: math.log((len(templates) + 1) / (k + 0.5)) for w, k in seen.items()}
    labels, top = set(), 0.0
    for label, t, must in templates:
        if not all(any(words[k : k + len(p)] == p for k in range(len(words))) for p in must):
            continue
        total = sum(idf[w] for w in t)
        near = [max(0.0, *[sum(idf[w] for p, w in enumerate(t) if w in words[max(0, b + p - slack) : max(0, b + p + slack + 1)]) for b in range(-len(t), len(words) + 1)]) / total]
        if near[0] >= share - 1e-9:
            labels.add(label)
            top = max(top, near[0])
    return labels, top


M_words = LIC.alnum_words


def test_license_index_against_every_begin(words):
    rng, index = random.Random(14), LIC.Index()
    all_ = LIC.TEMPLATES + LIC.WHOLE_TEXTS
    hits = 0
    for n in range(60):
        _, t, _ = all_[n % len(all_)]
        t = M_words(t)
        for _ in range(rng.randint(0, len(t) // 3)):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice(([], [t[at], rng.choice(words).encode()], [rng.choice(words).encode()], [b"the"]))
        other = M_words(rng.choice(all_)[1])
        text = [w.encode() for w in rng.choices(words, k=rng.randint(0, 20))] + t + rng.choice(([], other[: rng.randint(0, len(other))]))
        got, want = index.match(text), brute_licenses(text, 0.6, index.slack)
        assert got[0] == want[0] and got[1] == pytest.approx(min(1.0, want[1]))
        hits += bool(got[0])
    assert hits > 20


def test_license_scan_of_repeated_rows_and_long_texts(spark, words):
    rng = random.Random(15)
    long = " ".join(rng.choice(words) for _ in range(60_000)) + " " + LIC.WHOLE_TEXTS[0][1] + " under the MIT license " + " ".join(rng.choice(words) for _ in range(1000))
    rows = [(1, long), (1, long), (2, "All rights reserved"), (2, "All rights reserved"), (3, None)]
    got = Counter((r["doc_id"], r["labels"], r["n_base"]) for r in LIC.scan_licenses(table(spark, rows)).collect())
    assert got == {(1, "mit", 1): 2, (2, "all-rights-reserved", 0): 2, (3, "", 0): 1}


def exact_components(rows, width, share):
    sets = []
    for d, t in rows:
        w = M.space_words(t or "")
        size = min(width, len(w))
        sets.append((d, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()))
    name = {d: d for d, _ in sets if d is not None}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= share * len(x | y):
                p, q = find(a), find(b)
                name[max(p, q)] = min(p, q)
    return Counter((d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d, s in sets)


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, words, block):
    rng = random.Random(11)
    rows, k = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k * 13 % 997, " ".join(copy)))
            k += 1
    rows += [(2000, None), (2001, ""), (2002, "One"), (2003, "one"), (2004, "one two"), (None, rows[0][1]), (rows[3][0], rows[3][1]), (rows[0][0], "quite another text of six words")]
    got = Counter(map(tuple, M.near_duplicates(table(spark, rows).repartition(3), 3, 85, block).collect()))
    assert got == exact_components(rows, 3, 85)
    assert M.near_duplicates(table(spark, []), 3, 85).collect() == []


def test_pairs_at_the_threshold_are_hardly_missed():
    for share in (0.8, 0.85):
        for n in (M.POSTED, M.COORDINATES):
            short = lambda m: sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(m))  # noqa: B023, E731
            assert short(M.needed(n, share)) <= 1e-7 < short(M.needed(n, share) + 1)
    assert M.needed(M.COORDINATES, 1.0) == M.COORDINATES and M.needed(M.POSTED, 0.1) == 1


def test_block_pairs_do_not_overflow(spark):
    blocks = [(2047, 2048), (2048, 2048), (5000, 2048), (0, 1 << 19)]
    got = spark.createDataFrame(blocks, "a int, b int").select(M._pair_of(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r["p"] for r in got] == [(min(x) << 20) + max(x) for x in blocks]


def test_edit_fingerprints(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in P.edit_fingerprints(table(spark, rows).repartition(4)).collect()}
    assert len(got) == len(rows)
    for k, (_, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == P.as_text(P.embed([P.code_points(t)])[0])
        assert r["edited_fingerprint"] == P.as_text(P.embed([P.code_points(edited)])[0])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[0]["fingerprint"] == got[60]["fingerprint"] and got[60]["near_next"] == 1.0
    prose = [k for k in range(60) if got[k]["n_chars"] > 80]
    assert all(got[k]["near_edited"] > got[k]["near_next"] + 0.2 for k in prose)


def test_edit_fingerprints_odd_tables(spark):
    one = P.edit_fingerprints(table(spark, [(7, "alone in the world")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert P.edit_fingerprints(table(spark, [])).collect() == []
    rows = P.edit_fingerprints(table(spark, [(1, "b"), (1, "a"), (None, "c"), (2, None)])).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(False, 0, 1), (True, 1, 1), (True, 1, 1), (True, 2, 0)]


def test_edits_lower_the_likeness_and_bands_find_them(spark, words):
    rng = random.Random(2)
    t = " ".join(rng.choice(words) for _ in range(300))
    marks = [P.embed([P.code_points(x)])[0] for x in (t, t[:700] + t[703:], t[:400] + "zz" + t[400:], t[::-1])]
    assert P.likeness(marks[0], marks[1]) > 0.55 and P.likeness(marks[0], marks[2]) > 0.4 > P.likeness(marks[0], marks[3])
    prints = spark.createDataFrame([(k, P.as_text(m)) for k, m in enumerate((marks[0], marks[0], marks[2], marks[3]))], "doc_id long, fingerprint string")
    assert {(r["a"], r["b"]) for r in P.near_candidates(prints, threshold=0.5).collect()} == {(0, 2)}


@pytest.mark.parametrize("block", [2, 256])
def test_bands_compare_all_their_members(spark, block):
    rng = random.Random(12)
    noise = lambda: bytearray(rng.randrange(256) for _ in range(64))
    one = noise()
    two = one[:63] + bytes([one[63] ^ 1])
    # each band of the last two, of their own level and of the next, also holds a smaller one that is like neither
    next_level = np.flatnonzero(np.isin(P.sampled_times(0)[:64], P.sampled_times(1)))
    values = []
    for places in (np.arange(64), next_level):
        for k in range(0, len(places) - 3, 4):
            values.append(noise())
            for at in places[k : k + 4]:
                values[-1][at] = one[at]
    values = [bytes(v) for v in (*values, one, two)]
    prints = spark.createDataFrame([(k, P.as_text((0, 64, v))) for k, v in enumerate(values)], "doc_id long, fingerprint string")
    n = len(values)
    got = {(r["a"], r["b"]): r["near"] for r in P.near_candidates(prints, block=block).collect()}
    assert got == {(n - 2, n - 1): 63 / 64}


def labelled(spark, words, kind):
    """(documents, labels): label 1 is toxic or of quality, by planted words or signs."""
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(400):
        bad = rng.random() < 0.3
        w = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        if bad:
            for at in range(0, len(w), 6):
                w[at] = rng.choice(("grumbleword", "scoffword")) if kind == "toxic" else w[at].upper() + "%%%"
        docs.append((k, " ".join(w)))
        labels.append((k, int(not bad), int(bad)))
    docs += [(1000, None), (1001, ""), (None, "no id"), (5, docs[5][1])]
    return table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(got, labels, column):
    rows = [r for r in got.join(labels, "doc_id").collect() if r["held_out"]]
    return sum(r["predicted"] == r[column] for r in rows) / len(rows)


def test_toxicity(spark, words):
    docs, labels = labelled(spark, words, "toxic")
    got = TOX.score_toxicity(docs, TOX.train(docs, labels))
    assert got.count() == 404
    assert held(got, labels, "toxic") > 0.97
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) or r["doc_id"] is None
    # held-out labels teach nothing
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same_model(TOX.train(docs, turned), TOX.train(docs, labels))
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert TOX.score_toxicity(docs, TOX.train(docs, none)).where("predicted = 1").count() == 0
    assert TOX.score_toxicity(docs.limit(0), TOX.train(docs.limit(0), labels)).collect() == []


def same_model(a, b):
    assert set(a[0]) == set(b[0]) and abs(a[1] - b[1]) < 1e-8
    assert max(abs(v - b[0][f]) for f, v in a[0].items()) < 1e-8


def test_the_model_does_not_hang_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").withColumn("toxic", F.greatest("toxic", F.when(F.col("doc_id") % 7 == 1, 1).otherwise(0)))
    first = TOX.train(docs, labels)
    assert first[0]
    scores = {r["doc_id"]: r["score"] for r in TOX.score_toxicity(docs, first).collect()}
    for parts in (1, 4, 16, 64):
        again = TOX.train(docs.repartition(parts), labels.repartition(parts))
        same_model(first, again)
        got = {r["doc_id"]: r["score"] for r in TOX.score_toxicity(docs, again).collect()}
        assert max(abs(v - got[k]) for k, v in scores.items()) < 1e-9


def test_the_risk_is_at_its_minimum():
    rng = np.random.default_rng(3)
    p, u = rng.random((40, 5)) < 0.4, rng.random((300, 5)) < 0.2
    prior, decay, soft = 0.2, 1e-3, 1e-2
    w = TOX.nnpu(p, u, prior, decay)
    p1, u1 = np.hstack([p, np.ones((40, 1))]), np.hstack([u, np.ones((300, 1))])
    loss = lambda z: np.logaddexp(0, -z)

    def risk(w):
        n = loss(-(u1 @ w)).mean() - prior * loss(-(p1 @ w)).mean()
        return prior * loss(p1 @ w).mean() + soft * np.logaddexp(0, n / soft) + decay / 2 * (w[:-1] @ w[:-1] + 1e-3 * w[-1] ** 2)

    assert all(risk(w) <= risk(w + rng.standard_normal(6) * scale) for scale in (1, 1e-2, 1e-4) for _ in range(200))


def test_non_negative_risk_recovers_hidden_positives():
    rng = np.random.default_rng(1)
    p = np.hstack([rng.random((300, 1)) < 0.9, rng.random((300, 3)) < 0.3])
    y = rng.random(900) < 0.3
    u = np.hstack([(rng.random((900, 1)) < np.where(y, 0.9, 0.02)[:, None]), rng.random((900, 3)) < 0.3])
    w = TOX.nnpu(p, u, 0.3)
    g = u @ w[:-1] + w[-1]
    assert np.mean((g > 0) == y) > 0.9


def test_quality(spark, words):
    docs, labels = labelled(spark, words, "quality")
    model = Q.train(docs, labels)
    got = Q.score_quality(docs, model)
    assert got.count() == 404 and held(got, labels, "quality") > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.collect())
    v = np.stack([Q.vector_of(t) for t in ("alpha beta", "GAMMA%%% x", "")])
    z = Q.latent(v, model)
    near = z.astype(float) @ model["refs"].T.astype(float)
    for row, s in zip(near, Q.vote(z, model["refs"], model["y"]), strict=True):
        top = np.argsort(-row)[:15]
        weight = np.maximum(row[top], 0) ** 8 + 1e-9
        assert math.isclose(s, (weight * model["y"][top]).sum() / weight.sum(), rel_tol=1e-3, abs_tol=1e-3)
    empty = Q.score_quality(docs, Q.train(docs, labels.limit(0)))
    assert {r["score"] for r in empty.collect()} == {0.5}


def test_mixing(spark, texts):
    rng = random.Random(5)
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice("aaab"), 0) for k, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight int")
    want = {"source": {"a": 0.5, "b": 0.5, "never": 1.0}}
    got = X.mix(docs, want).toPandas()
    assert len(got) == len(rows)
    mass = got.n_tokens * got.weight
    assert abs(mass[got.source == "a"].sum() / mass.sum() - 0.5) < 1e-6
    for d, temper in (("lang", 0.7), ("topic", 1.0)):
        goal = got.groupby(d).n_tokens.sum()
        goal = goal[goal > 0] ** temper
        have = mass.groupby(got[d]).sum()
        assert all(abs(have[k] / mass.sum() - goal[k] / goal.sum()) < 1e-5 for k in goal.index)
    assert ((got.probability >= 0) & (got.probability <= 1)).all() and abs(got.probability.max() - 1) < 1e-9
    assert got[got.n_tokens == 0].sampled.sum() == 0
    again = X.mix(docs.repartition(3), want).toPandas()
    assert sorted(again[again.sampled].doc_id) == sorted(got[got.sampled].doc_id)
    assert X.mix(docs.limit(0)).collect() == []


def test_tiny_levels_do_not_starve_the_mix(spark, words):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(words) for _ in range(80)), "en" if k % 3 else "fr", "a" if k % 4 else "b") for k in range(1000)]
    schema = "doc_id long, text string, lang string, source string"
    share = lambda r: X.mix(spark.createDataFrame(r, schema)).where("sampled").count() / len(r)
    plain = share(rows)
    assert plain > 0.5
    assert abs(share([*rows, (9000, "two words", "en", None)]) - plain) < 0.02
    # source and language of one document alone want different masses of it
    with pytest.warns(RuntimeWarning, match="not settled"):
        assert abs(share([*rows, (9000, "two words", None, None)]) - plain) < 0.02
    # many small sources hold much of the goal: half of the tokens is still drawn
    with pytest.warns(RuntimeWarning, match="drawn whole"):
        assert share([*rows, *[(10000 + k, "two words", "en", f"s{k}") for k in range(300)]]) > 0.5


def test_word_counts_of_mixing(spark):
    rows = [("", 0), (None, 0), ("a", 1), (" a b\nc ", 3), ("   ", 0)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "text string").select(X.n_tokens_of(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in got] == [n for _, n in rows]


def test_components(spark):
    from thalweg.llm.components import components

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(501, 560)]
    name = list(range(600))
    find = lambda x: x if name[x] == x else find(name[x])
    for a, b in edges:
        a, b = find(a), find(b)
        name[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def walked(text):
    """The fingerprint of a text, character by character: an independent walk over the same shared random bits."""
    codes = [ord(c) for c in text]
    at, t, i = [], 0, 0
    while i < len(codes):
        at.append(i)
        kind = (codes[i] * 2654435761 % 2**32) >> 24
        bit = (int(P._mix(np.array([t % P.PERIOD * 256 + kind], np.uint64))[0]) >> 33) & 1
        i, t = i + bit, t + 1
    level = max(0, (t // P.SAMPLES).bit_length() - 1)
    ends = [*codes, 0, 0]
    out = []
    for time in P.sampled_times(level).tolist():
        if time < t:
            v = sum(c * int(m) for c, m in zip(ends[at[time] : at[time] + 3], (P._MIX[0], P._MIX[1], P._MIX[2]), strict=True)) % 2**64
            out.append(((v ^ (v >> 29)) * int(P._MIX[1]) % 2**64) >> 56)
    return (level, t, bytes(out)) if codes else (0, 0, b"")


def test_fingerprints_against_a_walk_by_single_characters(texts):
    for t in (*texts[:12], "", "a", "ab", "é\U0001f600 x", "x" * 900):
        if t is not None:
            assert P.embed([P.code_points(t)])[0] == walked(t)


def test_near_groups_against_all_pairs(spark, words):
    rng = random.Random(31)
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 3, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k * 17 % 1009, " ".join(copy)))
            k += 1
    rows += [(5000, ""), (5001, None), (None, rows[0][1]), (rows[3][0], "another text under an id that is there already"), rows[0]]
    prints = P.edit_fingerprints(table(spark, rows)).select("doc_id", "fingerprint")
    got = P.near_groups(prints).collect()
    assert len(got) == len(rows)
    name = {}
    find = lambda x: x if name.setdefault(x, x) == x else find(name[x])
    marks = [(r["doc_id"], P.from_text(r["fingerprint"])) for r in got if r["doc_id"] is not None]
    for i, (a, x) in enumerate(marks):
        for b, y in marks[i:]:
            if a == b or x == y or (len(x[2]) and P.likeness(x, y) >= 0.5):
                p, q = find(a), find(b)
                name[max(p, q)] = min(p, q)
    assert {r["doc_id"]: r["near_id"] for r in got if r["doc_id"] is not None} == {a: find(a) for a, _ in marks}
    assert [r["near_id"] for r in got if r["doc_id"] is None] == [None]
    assert P.near_groups(prints.limit(0)).collect() == []


def test_a_large_cluster_is_one_component(spark, words):
    rng = random.Random(41)
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for k in range(700):
        copy = list(base)
        copy[rng.randrange(120)] = rng.choice(words)
        rows.append((k, " ".join(copy)))
    other = [rng.choice(words) for _ in range(100)]
    rows += [(1000 + k, " ".join([*other[: 100 - k % 2], "tail"])) for k in range(5)]
    got = M.near_duplicates(table(spark, rows), 3, 85, 64).groupBy("component_id").count().collect()
    assert Counter(map(tuple, got)) == exact_sizes(rows)


def exact_sizes(rows):
    return Counter(Counter(c for _, _, c, _ in exact_components(rows, 3, 85).elements()).items())


@pytest.mark.parametrize("scorer", ["toxic", "quality"])
def test_scores_of_long_texts_empty_tables_and_ties(spark, words, scorer):
    rng = random.Random(51)
    docs, labels = labelled(spark, words, scorer)
    module, column = (TOX, "toxic") if scorer == "toxic" else (Q, "quality")
    score = TOX.score_toxicity if scorer == "toxic" else Q.score_quality
    model = module.train(docs, labels.unionByName(labels).withColumn("text", F.lit("x")))
    marks = ("grumbleword", "scoffword") if scorer == "toxic" else [w.upper() + "%%%" for w in words]
    n = 60_000 if scorer == "toxic" else 70  # nearest neighbours of a text much longer than all labelled ones mean little
    plain = " ".join(rng.choice(words) for _ in range(n))
    bad = " ".join(rng.choice(marks) if k % 6 == 0 else rng.choice(words) for k in range(n))
    rows = [(1, plain), (2, bad), (3, plain), (3, plain), (4, ""), (5, None), (6, plain * (60_000 // n))]
    got = {r["doc_id"]: r for r in score(table(spark, rows), model).collect()}
    flagged = 1 if scorer == "toxic" else 0
    assert (got[2]["predicted"], got[1]["predicted"]) == (flagged, 1 - flagged)
    assert got[1]["score"] == got[3]["score"] and got[4]["score"] == got[5]["score"] and 0 <= got[6]["score"] <= 1
    assert score(table(spark, rows), model).count() == len(rows) and score(table(spark, []), model).collect() == []
    assert score(table(spark, rows), module.train(docs.limit(0), labels)).count() == len(rows)


def test_targets_as_a_table_and_a_topic_column(spark, words):
    rng = random.Random(61)
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90))), "en", rng.choice("ab"), rng.choice(["law", "art", None])) for k in range(400)]
    docs = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string, lang string, source string, probability string")
    want = spark.createDataFrame([("topic", "law", 3.0), ("topic", "art", 1.0), ("source", "a", 0.5), ("source", "b", 0.5), ("other", "x", 1.0)], "dimension string, level string, share double")
    got = X.mix(docs, want, topic=F.col("probability")).toPandas()
    mass = got.n_tokens * got.weight
    share = mass.groupby(got.topic).sum() / mass.sum()
    assert share["law"] == pytest.approx(0.75, abs=1e-5) and share["art"] == pytest.approx(0.25, abs=1e-5) and share["(none)"] == 0
    assert got[got.topic == "(none)"].sampled.sum() == 0 and len(got) == 402
    assert got[got.doc_id == 0].sampled.nunique() == 1
    given = {"topic": {"law": 3.0, "art": 1.0}, "source": {"a": 0.5, "b": 0.5}}
    assert sorted(X.mix(docs, given, topic=F.col("probability")).where("sampled").toPandas().doc_id) == sorted(got[got.sampled].doc_id)
    forms = {t: spark.createDataFrame([(t,)], "text string").select(X.form_of(F.col("text")).alias("f")).first()["f"] for t in ("plain words here", "x | 12 | 9 | {}", "a\nb\nc\nd", "word " * 300, "", None)}
    assert list(forms.values()) == ["short prose", "marked", "lines", "long prose", "short prose", "short prose"]
