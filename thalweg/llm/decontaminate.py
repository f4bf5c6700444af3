"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

A benchmark of up to ``most_bytes`` of text is one automaton, sent to every
task. A larger one is not collected: a bit map of fixed size tells which windows
of a text may be benchmark windows, and those are joined with them.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import alnum_words, keeps, map_arrow, materialize, partitions

_AUTOMATA: dict = {}
keeps("automata", _AUTOMATA.clear)


def windows_of(words: list[bytes], width: int) -> list[tuple[str, int]]:
    """The windows of an item, each between spaces, with its number of words; bytes stand as code points 0-255."""
    if not words:
        return []
    size = min(width, len(words))
    return [((b" " + b" ".join(words[k : k + size]) + b" ").decode("latin-1"), size) for k in range(len(words) - size + 1)]


def automaton(items: list[tuple[str, str]], width: int):
    """Over all windows; a window's value: how many words it has and which items hold it."""
    import ahocorasick

    known: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        for w, size in windows_of(alnum_words(text), width):
            known.setdefault(w, (size, []))[1].append(item)
    a = ahocorasick.Automaton()
    for w, (size, names) in known.items():
        a.add_word(w, (size, tuple(dict.fromkeys(names))))
    if known:
        a.make_automaton()
    return a if known else None


def scan(text: str, a) -> tuple[int, np.ndarray, set[str]]:
    """Words of the text, which of them are hit, and the items that occur.

    The text is scanned once; a match's end is mapped to the word it ends, and
    the words' places lead back to the original (``spans``).
    """
    words = alnum_words(text)
    hit, items = np.zeros(len(words), bool), set()
    if a is None or not words:
        return len(words), hit, items
    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = list(a.iter(flat))
    if found:
        ends = np.cumsum([len(w) + 1 for w in words])  # of each word: the place of the space after it
        last = np.searchsorted(ends, [e for e, _ in found])
        for k, (_, (size, names)) in zip(last, found, strict=True):
            hit[k - size + 1 : k + 1] = True
            items.update(names)
    return len(words), hit, items


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point ranges of the original text that the hit words take, runs of words joined."""
    from thalweg.llm.common import _ALNUM

    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(_ALNUM), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[False], flat, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return [(len(raw[: begin[a]].decode("utf-8", "surrogatepass")), len(raw[: end[b - 1]].decode("utf-8", "surrogatepass"))) for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True)]


BITS = 1 << 26  # of the bit map over the windows of a large benchmark (8 MB)


def _digests(words: list[bytes], size: int) -> list[bytes]:
    return [hashlib.blake2b(b" ".join(words[k : k + size]), digest_size=16).digest() for k in range(len(words) - size + 1)]


def _bit(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") % BITS


def _hits_by_join(texts: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(key, starts, sizes, items) of the texts (key, _text) in which windows of the items occur.

    Items' windows are dealt by their 128-bit digests. Only windows of texts
    whose bit is set are shuffled, and what reaches the driver is the bit map
    and the lengths of windows, whatever the size of the benchmark.
    """
    spark = texts.sparkSession

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = alnum_words(text)
            if words:
                size = min(width, len(words))
                out += [(d, size, item) for d in set(_digests(words, size))]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.string()), strict=True)], names=["window", "size", "item"]) if out else None

    windows = materialize(map_arrow(items, cut, "window binary, size int, item string"), "benchmark-windows")

    def flag(batches):
        bits = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            at = np.array([_bit(d) for d in batch.column("window").to_pylist()], np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        step = 1 << 16
        for k in range(0, len(bits), step):
            if bits[k : k + step].any():
                yield pa.record_batch([pa.array([k], pa.int64()), pa.array([bits[k : k + step].tobytes()], pa.binary())], names=["at", "bits"])

    def unite(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column("at").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                x = np.frombuffer(b, np.uint8)
                held[k] = held[k] | x if k in held else x
        for k, x in held.items():
            yield pa.record_batch([pa.array([k], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["at", "bits"])

    bits = np.zeros(BITS // 8, np.uint8)
    flags = windows.select("window").mapInArrow(flag, "at long, bits binary").repartition(partitions(spark), "at").mapInArrow(unite, "at long, bits binary")
    for r in flags.toLocalIterator():  # at most BITS / 8 bytes
        bits[r["at"] : r["at"] + len(r["bits"])] |= np.frombuffer(r["bits"], np.uint8)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``width`` numbers
    shared = spark.sparkContext.broadcast((bits, sizes))

    def look(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        bits, sizes = shared.value
        out = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            words = alnum_words(text)
            for size in sizes:
                for k, d in enumerate(_digests(words, size)):
                    b = _bit(d)
                    if bits[b >> 3] >> (b & 7) & 1:
                        out.append((key, d, size, k))
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "window", "size", "start"]) if out else None

    maybe = materialize(map_arrow(texts.select("key", "_text"), look, "key binary, window binary, size int, start long"), "possible-hits")
    places = maybe.distinct().join(windows.select("window", "size").distinct(), ["window", "size"], "left_semi")
    each = places.groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("places"))
    named = places.select("key", "window", "size").distinct().join(windows, ["window", "size"]).select("key", "item").distinct().groupBy("key").agg(F.collect_list("item").alias("items"))
    return each.join(named, "key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, most_bytes: int = 1 << 20, keep: tuple[str, ...] = (), with_spans: bool = False) -> DataFrame:
    """Mark the words of each text that windows of ``width`` benchmark words cover.

    A document is contaminated if at least one word in twenty is hit. Returns
    doc_id, n_words, n_hit, n_items, items_sha256, contaminated and, if asked
    for, the hit ranges in code points of the original; one row for each input
    row, repeated rows included. With ``keep`` these columns of ``docs`` are
    carried along and the results' names begin with an underscore. Null and
    empty texts have no words and are clean; items without words or id find
    nothing; equal items share their windows and are all listed. An empty table
    gives no rows, an empty benchmark marks nothing.

    A benchmark of at most ``most_bytes`` of UTF-8 is one automaton in every
    worker: the texts are read once and nothing is shuffled. Beyond that see
    ``_hits_by_join``; both give the same rows.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    kept = [f"_keep_{k}" for k in range(len(keep))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    results = [("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean"), *([("spans", "array<struct<begin:bigint,end:bigint>>")] if with_spans else [])]
    schema = ", ".join(["doc_id bigint", *(f"{c} {t}" for c, t in results), *(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept)])

    def answer(batch: pa.RecordBatch, found: list[tuple[str, np.ndarray, list[str]]]) -> pa.RecordBatch:
        """``found``: text, hit words, names of the items in order."""
        n_words, n_hit = [len(h) for _, h, _ in found], [int(h.sum()) for _, h, _ in found]
        out = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(f) for _, _, f in found], pa.int64()), pa.array([hashlib.sha256(",".join(f).encode()).hexdigest() for _, _, f in found]), pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_())]
        if with_spans:
            out.append(pa.array([[{"begin": a, "end": b} for a, b in spans(t, h)] if f else [] for t, h, f in found], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))
        return pa.record_batch([batch.column("doc_id"), *out, *(batch.column(k) for k in kept)], names=["doc_id", *(c for c, _ in results), *kept])

    if size <= most_bytes:
        shared, name = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in items.orderBy("item", "text").collect()]), uuid.uuid4().hex  # at most ``most_bytes`` of text

        def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
            if name not in _AUTOMATA:
                _AUTOMATA.clear()
                _AUTOMATA[name] = automaton(shared.value, width)
            found = [(t, *scan(t, _AUTOMATA[name])[1:]) for t in batch.column("_text").to_pylist()]
            return answer(batch, [(t, hit, sorted(names)) for t, hit, names in found])

        out = map_arrow(rows, mark, schema, cache="automata")
    else:
        keyed = rows.withColumn("key", F.expr("unhex(sha2(_text, 256))"))
        hits = _hits_by_join(keyed, items, width)

        def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for text, places, names in zip(batch.column("_text").to_pylist(), batch.column("places").to_pylist(), batch.column("items").to_pylist(), strict=True):
                hit = np.zeros(len(alnum_words(text)), bool)
                for p in places or ():
                    hit[p["start"] : p["start"] + p["size"]] = True
                found.append((text, hit, sorted(names or ())))
            return answer(batch, found)

        out = map_arrow(keyed.join(hits, "key", "left").drop("key"), gather, schema)
    return out.select(*[F.col(c).alias(f"_{c}" if keep else c) for c in ("doc_id", *(c for c, _ in results))], *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)])
