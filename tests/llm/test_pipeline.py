"""The pipeline's stages on planted documents."""

import random

import pytest

import corpus_pipeline as CP
from thalweg.llm.tokens import load, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(30)) for k in range(5)]
    docs, labels = {}, []
    for k in range(200):
        text = prose(60)
        if k % 4 == 0:
            text = " ".join(w if i % 5 else "grumbleword" for i, w in enumerate(text.split()))
        docs[k] = text
        labels.append((k, 1, int(k % 4 == 0)))
    docs[300] = docs[1]
    docs[301] = docs[2].replace(docs[2].split()[30], "changed", 1)
    docs[302] = "start " + items[2][1] + " end"
    docs[303], docs[304] = "", None
    rows = [(k, t, rng.choice(["en", "de"]), rng.choice("abc"), len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs


def test_stages(spark, folder):
    root, docs = folder
    now, kept = spark.read.parquet(f"{root}/documents.parquet"), [set(docs)]
    for name, stage in CP.STAGES[:-1]:
        now = CP.materialize(stage(spark, now, root), name)
        assert now.columns == COLUMNS
        kept.append({r["doc_id"] for r in now.collect()})
    assert kept[0] - kept[1] == {k for k in range(200) if k % 4 == 0}
    assert kept[1] - kept[2] == {300, 301}
    assert kept[2] - kept[3] == {302}
    assert kept[4] <= kept[3] and len(kept[4]) > 0.3 * len(kept[3]) and not kept[4] & {303, 304}
    out = CP.STAGES[-1][1](spark, now, root).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in out] == sorted(kept[4])
    lib, at = load(tokenizer_path("word_bpe_49k.json")), 0
    for r in out:
        assert (r["start"], r["n_tokens"]) == (at, len(lib.encode(docs[r["doc_id"]], add_special_tokens=False).ids) + 1)
        at += r["n_tokens"]
    assert sorted(map(tuple, CP.run(spark, root).collect())) == sorted(map(tuple, out))


def test_repeated_ids_and_no_documents(spark, folder):
    root, _ = folder
    rows = [(1, "a b c d e f g", "en", "a", 1), (1, "a b c d e f g", "en", "a", 1), (None, "a b c d e f g", "en", "a", 1), (2, "h i", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] or 0) for r in CP.near_dedup(spark, docs, root).collect()) == [0, 1, 2]
    none = docs.limit(0)
    for _, stage in CP.STAGES:
        assert stage(spark, none, root).collect() == []


def test_other_texts_of_a_repeated_id_are_documents_of_their_own(spark, folder):
    root, _ = folder
    rows = [(1, "a b c d e f g", "en", "a", 1), (1, "quite another text of many words here", "en", "a", 1), (2, "a b c d e f g", "en", "a", 1), (3, "a text of its own that stays as well", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"], r["text"]) for r in CP.near_dedup(spark, docs, root).collect())
    assert len(kept) == 3 and (1, rows[1][1]) in kept and (3, rows[3][1]) in kept


def test_repeated_ids_with_columns_that_have_no_order(spark, folder):
    root, docs = folder
    rows = [(7, docs[1], {"a": 1}), (7, docs[1], {"b": 2}), (7, docs[2], None), (5, docs[2], {"c": 3}), (9, docs[5], {}), (None, docs[5], {"d": 4})]
    table = spark.createDataFrame(rows, "doc_id long, text string, extra map<string, int>").selectExpr("doc_id", "text", "'en' as lang", "'a' as source", "1L as n_chars", "extra")
    kept = CP.near_dedup(spark, table, root).collect()
    # of id 7's second text and its copy 5 the smaller id stays; one row of the repeated one
    assert sorted(((r["doc_id"] or 0), r["text"] == docs[2]) for r in kept) == [(0, False), (5, True), (7, False), (9, False)]
    assert {tuple(r["extra"].items()) for r in kept if r["doc_id"] == 7} <= {(("a", 1),), (("b", 2),)}
    again = CP.near_dedup(spark, table.repartition(5), root).collect()
    key = lambda r: str(r["doc_id"])
    assert sorted(kept, key=key) == sorted(again, key=key)


def test_null_columns_long_texts_and_columns_that_clash(spark, folder):
    root, docs = folder
    rng = random.Random(4)
    words = sorted({w for t in docs.values() if t for w in t.split() if w != "grumbleword"})
    long = " ".join(rng.choice(words) for _ in range(40_000))
    rows = [(k, docs[k], None if k % 3 else "en", None if k % 2 else "a", None, True, 0.5, "x", 7, "y") for k in range(1, 60) if k % 4] + [(900, long, "de", "b", 1, False, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, `set` string, `_id` int, `row` string")
    now = table
    for name, stage in CP.STAGES[:-1]:
        now = CP.materialize(stage(spark, now, root), name)
        assert now.columns == table.columns
        if name != "mixing":
            assert now.count() == len(rows), name
    out = {r["doc_id"]: r["n_tokens"] for r in CP.STAGES[-1][1](spark, now, root).collect()}
    assert out and set(out) <= {r[0] for r in rows}
    if 900 in out:
        assert out[900] == len(load(tokenizer_path("word_bpe_49k.json")).encode(long, add_special_tokens=False).ids) + 1
