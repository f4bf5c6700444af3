"""Exact repeated substrings, suffix bucket by suffix bucket.

A suffix array over a whole corpus need not be held at once: suffixes are dealt
to buckets, each bucket is sorted by itself, and a sample of the suffixes tells
which can be equal. The sample here is a content-defined cover: the minimisers
of a window. Like a difference cover it holds, for any two equal strings of
``length`` bytes, a position at the same place in both, but at one position in
about 140 instead of one in eleven, and it aligns the suffixes: two positions
can start equal strings only if the cover samples of their windows are equal,
so each bucket is the suffixes around one cover sample.

1. Equal texts are one text with a number of copies.
2. Cover samples of all texts are counted; only those whose ``context`` bytes
   occur at least twice can lie in a repeated string.
3. Each such place gives a slice of text that reaches over all starts it covers.
   Equal slices are counted and keep one copy: their starts repeat as a whole.
4. Inside a bucket the suffixes behind the sample and, read backwards, the
   prefixes before it are sorted by their bytes. The longest common prefixes of
   neighbours give the ranks of both at any depth; starts at the same distance
   from the sample are equal exactly if both their ranks are.
5. The marked starts of a text are joined to runs of bytes and taken out.

Hashes deal texts, slices and buckets; that two strings are equal is decided on
their bytes, or by 128 bits of a cryptographic digest where they lie in
different tasks (equal texts, equal slices, buckets too large for one task).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import map_arrow, materialize, partitions, small_batches, text_rows

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, np.uint64(base), np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


_BYTE = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def ranks(b: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name of the ``length`` bytes from each position on: a polynomial in random byte values, mixed."""
    n = len(b) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])
    return _mix((total[length:] - total[:-length]) * down[:n])


def cover(names: np.ndarray, window: int) -> np.ndarray:
    """For each window of names, the place of its smallest one (the leftmost if several are equal)."""
    n = len(names) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # minima over blocks of the window's size from both sides meet in every window
    pad = -len(names) % window
    x = np.concatenate([names, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, window)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])
    # the leftmost place of the minimum: candidates are places that are the minimum of some window
    start = np.arange(n)
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    out = np.empty(n, np.int64)
    ends = np.concatenate([change[1:], [n]])
    for a, e in zip(change.tolist(), ends.tolist(), strict=True):
        value = least[a]
        places = a + np.flatnonzero(names[a : e - 1 + window] == value)
        out[a:e] = places[np.searchsorted(places, start[a:e])]
    return out


def samples(text: bytes, length: int, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cover samples of a text: name, place, first and last start of a ``length``-byte string that each covers."""
    b = np.frombuffer(text, np.uint8)
    if len(b) < length:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    names = ranks(b, context)
    at = cover(names, length - context + 1)
    change = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([change[1:], [len(at)]]) - 1
    return names[at[change]], at[change], change, last


def _pack(places: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """First start (40 bits), place of the sample after it and number of starts after the first (12 bits each) in one number."""
    if len(firsts) and (max((places - firsts).max(), (lasts - firsts).max()) >= 1 << 12 or firsts.max() >= 1 << 39):
        raise ValueError("length is too large")
    return (firsts << 24) | ((places - firsts) << 12) | (lasts - firsts)


def _unpack(where: int) -> tuple[int, int, int]:
    """First and last start, and the sample's place after the first."""
    first = where >> 24
    return first, first + (where & 0xFFF), (where >> 12) & 0xFFF


def _depths(sides: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of byte strings and the longest common prefix of each with the one before it."""
    n = len(sides)
    order = np.array(sorted(range(n), key=sides.__getitem__))
    sizes = np.array([len(x) for x in sides])
    width = int(sizes.max(initial=0))
    grid = np.frombuffer(b"".join(sides[k].ljust(width, b"\xff") for k in order.tolist()), np.uint8).reshape(n, width)
    differ = grid[1:] != grid[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(n - 1, np.int64)
    return order, np.minimum(common, np.minimum(sizes[order[1:]], sizes[order[:-1]]))


def _flags(rows: list[tuple[int, bytes]], length: int) -> list[np.ndarray]:
    """For each of a bucket's distinct slices (place of the sample in it, bytes): which of its starts repeat in another.

    Starts count as equal only at the same distance before the sample, which
    equal strings share.
    """
    n = len(rows)
    before = np.arange(max(place for place, _ in rows) + 1)  # distances of starts from the sample
    ranked = []
    for sides, depth in (([piece[place::-1][1:] if place else b"" for place, piece in rows], before), ([piece[place:] for place, piece in rows], length - before)):
        order, common = _depths(sides)
        rank = np.zeros((n, len(before)), np.int64)
        rank[1:] = np.cumsum(common[:, None] < depth, axis=0)
        at = np.empty_like(rank)
        at[order] = rank
        ranked.append(at)
    places, sizes = np.array([place for place, _ in rows]), np.array([len(piece) for _, piece in rows])
    starts = (before <= places[:, None]) & (length - before <= (sizes - places)[:, None])
    key = ((before * n + ranked[0]) * n + ranked[1])[starts]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    found = np.zeros(len(key), bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    flag = np.zeros(starts.shape, bool)
    flag[starts] = found
    return [flag[k, place::-1][: size - length + 1] for k, (place, size) in enumerate(zip(places.tolist(), sizes.tolist(), strict=True))]


def _runs(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _bucket_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Sorts one bucket after the other: rows come ordered by name; gives (name, mark, begin, end) of repeated starts."""
    held: list[tuple[bytes, int, bytes, int]] = []
    now = None
    out: list[tuple[int, bytes, int, int]] = []

    def close() -> None:
        if not held:
            return
        flags = _flags([(place, piece) for _, place, piece, _ in held], length) if len(held) > 1 else [None]
        for (mark, _, piece, n), flag in zip(held, flags, strict=True):
            if n > 1:
                out.append((now, mark, 0, len(piece) - length + 1))
            elif flag is not None:
                out.extend((now, mark, a, e) for a, e in _runs(flag))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["name", "mark", "begin", "end"])

    for batch in small_batches(batches):
        for name, mark, place, piece, n in zip(*(batch.column(c).to_pylist() for c in ("name", "mark", "place", "piece", "n")), strict=True):
            if name != now:
                close()
                held, now = [], name
                if len(out) > 4096:
                    yield batch_of()
                    out.clear()
            held.append((mark, place, piece, n))
    close()
    if out:
        yield batch_of()


def _digest(piece: bytes, place: int) -> bytes:
    return hashlib.blake2b(piece + place.to_bytes(8, "little", signed=True), digest_size=16).digest()


def _wide_runs(slices: DataFrame, length: int) -> DataFrame:
    """The same for buckets too large for one task: every start is dealt by the digest of its bytes instead."""

    def starts(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, marks, at, keys = [], [], [], []
        for name, mark, place, piece in zip(*(batch.column(c).to_pylist() for c in ("name", "mark", "place", "piece")), strict=True):
            n = len(piece) - length + 1
            names += [name] * n
            marks += [mark] * n
            at.append(np.arange(n))
            keys += [_digest(piece[k : k + length], k - place) for k in range(n)]
        return pa.record_batch([pa.array(names, pa.int64()), pa.array(marks, pa.binary()), pa.array(np.concatenate(at), pa.int64()), pa.array(keys, pa.binary())], names=["name", "mark", "begin", "rank"])

    every = map_arrow(slices, starts, "name long, mark binary, begin long, rank binary", most_bytes=1 << 20)
    repeated = every.groupBy("name", "rank").agg(F.count("*").alias("m")).where("m > 1").select("name", "rank")
    some = every.join(repeated, ["name", "rank"], "left_semi").select("name", "mark", "begin", (F.col("begin") + 1).alias("end"))
    whole = slices.where("n > 1").select("name", "mark", F.lit(0).cast("long").alias("begin"), (F.length("piece") - length + 1).cast("long").alias("end"))
    return some.unionByName(whole)


def remove_repeats(docs: DataFrame, length: int = 400, context: int = 120, bucket: int = 8192) -> DataFrame:
    """Remove each byte that a ``length``-byte string covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans (runs of removed bytes),
    kept_sha256, one row for each input row. Texts are UTF-8 bytes, strings do
    not cross texts, overlaps count, and all is judged on the input. Null and
    empty texts and texts shorter than ``length`` lose nothing. Rows that repeat
    a text, with the same id, another or none, are occurrences of their own: all
    of a long enough text goes. They are one text to the search, so repeated
    rows cost what one does. An empty table gives no rows; other columns do not
    matter. ``bucket``: from so many distinct slices on a suffix bucket is dealt
    start by start.
    """
    return spans_and_rest(docs, length, context, bucket)[0]


def spans_and_rest(docs: DataFrame, length: int = 400, context: int = 120, bucket: int = 8192) -> tuple[DataFrame, DataFrame]:
    """What ``remove_repeats`` returns, and the real output: (key, spans, kept) of each distinct text that loses bytes.

    ``key`` is the first half of the SHA-256 of the text.
    """
    spark = docs.sparkSession
    rows = text_rows(docs).select("doc_id", "text", F.sha2("text", 256).alias("sha")).withColumn("key", F.expr("substring(unhex(sha), 1, 16)"))
    long = rows.where(F.octet_length("text") >= length)
    copies = materialize(long.groupBy("key").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).cast("long").alias("size")).where("copies > 1").select("key", "size"), "equal-texts")

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, names, counts, places = [], [], [], []
        for key, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            name, place, first, last = samples(t.encode("utf-8", "surrogatepass"), length, context)
            order = np.argsort(name, kind="stable")
            name = name[order]
            begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else order
            keys += [key] * len(begin)
            names.append(name[begin].astype(np.int64))
            counts.append(np.diff(np.concatenate([begin, [len(name)]])))
            places.append(_pack(place, first, last)[order])
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array(np.concatenate(names), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places), pa.int64()))], names=["key", "name", "where"])

    # a text names each of its samples once, with all their places, however often a line repeats in it
    found = materialize(map_arrow(long.select("key", "text"), find, "key binary, name long, where array<long>"), "samples")
    twice = found.groupBy("name").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max(F.size("where")).alias("n")).where("n > 1 or a <> b").select("name")
    wanted = found.join(twice, "name", "left_semi").groupBy("key").agg(F.collect_set(F.struct("name", "where")).alias("found"))
    # the rows of a text meet before the shuffle and are one row behind it
    texts = long.groupBy("key").agg(F.first("text").alias("text"))
    hit = materialize(texts.join(wanted, "key"), "repeating-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in small_batches(batches, 1 << 20):
            out: list[tuple] = []
            for key, text, got in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                raw, here = text.encode("utf-8", "surrogatepass"), {}
                for s in got:
                    for where in set(s["where"]):
                        first, last, place = _unpack(where)
                        piece = raw[first : last + length]
                        mark = _digest(piece, place)
                        if (s["name"], mark) in here:
                            here[s["name"], mark][1].add(first)
                        else:
                            here[s["name"], mark] = (place, {first}, None if mark in seen else piece)
                            seen.add(mark)
                out += [(key, name, place, mark, sorted(firsts), piece) for (name, mark), (place, firsts, piece) in here.items()]
            if len(seen) > 300_000:
                seen.clear()
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "name", "place", "mark", "firsts", "piece"])

    slices = materialize(hit.select("key", "text", "found").mapInArrow(cut, "key binary, name long, place long, mark binary, firsts array<long>, piece binary"), "slices")
    # one copy of each distinct slice; the counts are summed map-side, so a slice that stands everywhere costs nothing
    distinct = materialize(slices.groupBy("name", "mark").agg(F.sum(F.size("firsts")).alias("n"), F.first("piece", ignorenulls=True).alias("piece"), F.min("place").alias("place")), "distinct-slices")
    wide = distinct.groupBy("name").agg(F.count("*").alias("m")).where(F.col("m") > bucket).select("name")
    narrow, tail = distinct, None
    if not wide.isEmpty():
        narrow, tail = distinct.join(wide, "name", "left_anti"), distinct.join(wide, "name", "left_semi")
    runs = narrow.repartition(partitions(spark), "name").sortWithinPartitions("name").select("name", "mark", "place", "piece", "n").mapInArrow(lambda batches: _bucket_runs(batches, length), "name long, mark binary, begin long, end long")
    if tail is not None:
        runs = runs.unionByName(_wide_runs(tail, length))
    ranges = slices.select("key", "name", "mark", "firsts").join(runs, ["name", "mark"]).groupBy("key").agg(F.collect_list(F.struct("firsts", "begin", "end")).alias("ranges"))

    def take_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, count, sha, kept, spans = [], [], [], [], []
        for text, got in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            gone = np.zeros(len(raw) + 1, np.int32)
            for r in got:
                firsts = np.array(r["firsts"])
                np.add.at(gone, firsts + r["begin"], 1)
                np.add.at(gone, firsts + r["end"] - 1 + length, -1)
            flag = np.cumsum(gone)[:-1] > 0
            rest = np.frombuffer(raw, np.uint8)[~flag].tobytes()
            edges = _runs(flag)
            removed.append(int(flag.sum()))
            count.append(len(edges))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
            spans.append([{"begin": a, "end": e} for a, e in edges])
        return pa.record_batch([batch.column("key"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["key", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    kinds = "key binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>, kept binary"
    parts = map_arrow(hit.join(copies, "key", "left_anti").select("key", "text").join(ranges, "key").select("key", "text", "ranges"), take_out, kinds)
    everything = copies.select("key", F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("size").alias("end"))).alias("spans"), F.lit(b"").alias("kept"))
    changed = parts.unionByName(everything)
    whole = rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), "sha")
    few = changed.select("key", "n_removed", "n_spans", "kept_sha256")
    out = whole.join(few, "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    return out, changed.select("key", "spans", "kept")
