"""Document fingerprints by randomised edit embedding.

A text is walked by one shared random walk: at each time step the character at
the walk's place is written down and a shared random bit of (time, character)
decides whether the walk moves on. Texts at a small edit distance give strings
at a small Hamming distance, because walks that an edit has driven apart meet
again. The fingerprint keeps the embedded string at shared sampled times; the
sampled sets are nested by level, so texts of different lengths stay
comparable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import materialize, partitions, small_batches, text_rows
from thalweg.llm.components import components
from thalweg.llm.minhash import across, near_at_hand, spanning

PERIOD = 1024  # of the shared random bits in time
SAMPLES = 64  # at least, for a text long enough; at most twice as many
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_TIMES: dict[int, np.ndarray] = {}
_STEPS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _steps() -> np.ndarray:
    """Time that the walk stays at a character of each class when it comes at each time of the period."""
    if not _STEPS:
        t = np.arange(PERIOD, dtype=np.uint64)
        stay = np.empty((256, PERIOD), np.int32)
        for c in range(256):
            bit = (_mix(t * np.uint64(256) + np.uint64(c)) >> np.uint64(33)) & np.uint64(1)
            move = np.flatnonzero(bit)
            after = np.concatenate([move, move[:1] + PERIOD])
            stay[c] = after[np.searchsorted(after, t.astype(np.int64))] - t.astype(np.int64) + 1
        _STEPS.append(stay.ravel())
    return _STEPS[0]


def sampled_times(level: int) -> np.ndarray:
    """Times below the reach of a level whose hash ends in at least ``level`` zero bits; each level holds the next."""
    if level not in _TIMES:
        reach, found = 2 * SAMPLES << level, []
        for at in range(0, reach, 1 << 20):
            t = np.arange(at, min(reach, at + (1 << 20)), dtype=np.uint64)
            found.append(t[(_mix(t + np.uint64(1 << 40)) & np.uint64((1 << level) - 1)) == 0])
        _TIMES[level] = np.concatenate(found).astype(np.int64)
    return _TIMES[level]


def embed(codes: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """(level, length of the embedded string, sampled values) of texts given as code points.

    All texts of the call walk side by side, longest first, so the loop takes
    as many steps as the longest has characters.
    """
    stay = _steps()
    lengths = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    ranked = lengths[order]
    active = np.searchsorted(-ranked, -np.arange(longest), side="left")  # texts longer than i
    offset = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(int(offset[-1]), np.uint8)
    for rank, k in enumerate(order[: active[0] if longest else 0]):
        flat[offset[: lengths[k]] + rank] = (codes[k].astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    came = np.empty(int(offset[-1]), np.int32)
    now = np.zeros(int(active[0]) if longest else 0, np.int32)
    place = np.empty_like(now)
    bounds = offset.tolist()
    for i in range(longest):
        a, b = bounds[i], bounds[i + 1]
        n = b - a
        t = now[:n]
        came[a:b] = t
        p = place[:n]
        np.multiply(flat[a:b], PERIOD, out=p, dtype=np.int32, casting="unsafe")
        p += t & (PERIOD - 1)
        t += stay.take(p)
    out: list = [None] * len(codes)
    for rank, k in enumerate(order):
        n = int(lengths[k])
        if not n:
            out[k] = (0, 0, b"")
            continue
        total = int(now[rank])
        level = max(0, (total // SAMPLES).bit_length() - 1)
        times = sampled_times(level)
        times = times[: np.searchsorted(times, total)]
        at = np.searchsorted(came[offset[:n] + rank], times, side="right") - 1
        c = np.concatenate([codes[k].astype(np.uint64), np.zeros(2, np.uint64)])
        v = c[at] * _MIX[0] + c[at + 1] * _MIX[1] + c[at + 2] * _MIX[2]
        out[k] = (level, total, ((v ^ (v >> np.uint64(29))) * _MIX[1] >> np.uint64(56)).astype(np.uint8).tobytes())
    return out


def as_text(mark: tuple[int, int, bytes]) -> str:
    return f"{mark[0]:02x}{mark[1]:010x}{mark[2].hex()}"


def from_text(text: str) -> tuple[int, int, bytes]:
    return int(text[:2], 16), int(text[2:12], 16), bytes.fromhex(text[12:])


def likeness(a: tuple[int, int, bytes], b: tuple[int, int, bytes]) -> float:
    """Share of the sampled times of the longer text at which the embedded strings agree; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    level = max(a[0], b[0])
    times = sampled_times(level)

    def at_level(m: tuple[int, int, bytes]) -> np.ndarray:
        v = np.frombuffer(m[2], np.uint8)
        if m[0] == level:
            return v
        own = sampled_times(m[0])[: len(v)]
        return v[np.isin(own, times)]

    x, y = at_level(a), at_level(b)
    n = min(len(x), len(y))
    return float(np.count_nonzero(x[:n] == y[:n]) / max(1, len(x), len(y)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, edge: rows to be sorted by (bucket, edge, doc_id, text) inside partitions by bucket.

    Buckets are ranges of doc_id. The first document of each bucket is added to
    the bucket before it (the very first to the last) as an ``edge`` row, so
    that each document meets its follower without any order over all rows in
    one task. Only the bounds and the first id of each bucket reach the driver.
    """
    spark = docs.sparkSession
    rows = text_rows(docs)
    n = partitions(spark)
    probs = [k / n for k in range(1, n)]
    bounds = sorted(set(int(b) for b in rows.select("doc_id").dropna().approxQuantile("doc_id", probs, 0.25 / n))) if probs else []
    if bounds:
        powers = [1 << k for k in reversed(range(len(bounds).bit_length()))]
        steps, literal = ",".join(map(str, powers)), ",".join(f"{b}L" for b in bounds)
        bucket = F.coalesce(F.expr(f"aggregate(array({steps}), 0, (lo, s) -> if(lo + s <= {len(bounds)} and element_at(array({literal}), least(lo + s, {len(bounds)})) <= doc_id, lo + s, lo))"), F.lit(0))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted((r["bucket"], r["first"]) for r in rows.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first")).collect())
    if not firsts:
        return rows.withColumn("edge", F.lit(False))
    before = [firsts[k - 1][0] for k in range(len(firsts))]
    edges = spark.createDataFrame([(b, f) for b, (_, f) in zip(before, firsts, strict=True)], "to int, first long")
    edge = rows.join(F.broadcast(edges), F.coalesce("doc_id", F.lit(-(2**63))) == F.col("first")).select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("edge"))
    return rows.withColumn("edge", F.lit(False)).unionByName(edge)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_fingerprints(docs: DataFrame, group: int = 1024, group_chars: int = 3_000_000) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose second half is the next document's beginning.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The last document is followed by the first. Null
    and empty texts have the fingerprint of no characters, which is like itself
    only. Rows of equal doc_id follow each other by text; a null doc_id comes
    first; a single document is its own follower. One shuffle of the texts.
    """

    def flush(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        own = [code_points(t) for _, t, _ in rows]
        # the follower of a row is mostly the next row
        follow = [k + 1 if k + 1 < len(rows) and rows[k + 1][1] is rows[k][2] else None for k in range(len(rows))]
        others = [code_points(rows[k][2]) if j is None else own[j] for k, j in enumerate(follow)]
        edited = [np.concatenate([c[: len(c) - len(c) // 2], o[: len(c) // 2]]) for c, o in zip(own, others, strict=True)]
        lone = [k for k, j in enumerate(follow) if j is None]
        marks = embed(own + edited + [others[k] for k in lone])
        n = len(rows)
        after = dict(zip(lone, marks[2 * n :], strict=True))
        following = [after[k] if j is None else marks[j] for k, j in enumerate(follow)]
        return pa.record_batch(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(c) for c in own], pa.int64()),
                pa.array([hashlib.sha256(e.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                pa.array([as_text(m) for m in marks[:n]]),
                pa.array([as_text(m) for m in marks[n : 2 * n]]),
                pa.array([likeness(a, b) for a, b in zip(marks[:n], marks[n : 2 * n], strict=True)]),
                pa.array([likeness(a, b) for a, b in zip(marks[:n], following, strict=True)]),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # complete rows: (doc_id, text, next text)
        chars = 0
        last = None  # the row that waits for its follower: (bucket, doc_id, text)
        for batch in small_batches(batches):
            for b, e, d, t in zip(*(batch.column(c).to_pylist() for c in ("bucket", "edge", "doc_id", "text")), strict=True):
                if last is not None and last[0] == b:
                    held.append((last[1], last[2], t))
                    chars += len(last[2])
                    last = None
                last = None if e else (b, d, t)
                if len(held) >= group or chars >= group_chars:
                    yield flush(held)
                    held, chars = [], 0
        if held:
            yield flush(held)

    rows = with_next(docs)
    return rows.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "edge", "doc_id", "text").select("bucket", "edge", "doc_id", "text").mapInArrow(run, SCHEMA)


def bands_of(mark: tuple[int, int, bytes], width: int, threshold: float) -> list[bytes]:
    """What a fingerprint is posted under: runs of ``width`` neighbouring samples, of its own level and of the next.

    A text that is long enough for its level to meet a partner of the next one
    (whose number of samples may be larger by 1 / threshold) is posted there as
    well. Fewer samples than ``width`` are one band.
    """
    level, total, v = mark
    out, at = [], np.frombuffer(v, np.uint8)
    if not len(at):
        return out
    uses = [(level, at)]
    if total >= threshold * (SAMPLES << (level + 1)):
        uses.append((level + 1, at[np.isin(sampled_times(level)[: len(at)], sampled_times(level + 1))]))
    for use, x in uses:
        raw = x.tobytes()
        out += [b"%d:%d:" % (use, k) + raw[k : k + width] for k in range(0, max(1, len(raw) - width + 1), width)]
    return out


def near_rows(marks: list[tuple[int, int, bytes]], side: np.ndarray, comp: np.ndarray, threshold: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """(x, rest) -> which of the places ``rest`` may meet x and are at least ``threshold`` like it.

    The samples stand in a table for each level, those of shorter texts thinned
    to it; texts more than one level apart share no band.
    """
    levels = np.array([m[0] for m in marks])
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for level in set(levels.tolist()):
        samples = []
        for own, _, v in marks:
            x = np.frombuffer(v, np.uint8) if own in (level - 1, level) else np.zeros(0, np.uint8)
            samples.append(x if own == level else x[np.isin(sampled_times(own)[: len(x)], sampled_times(level))])
        sizes = np.array([len(x) for x in samples])
        table = np.full((len(marks), max(1, int(sizes.max()))), 256, np.uint16)  # 256: beyond the end
        for k, x in enumerate(samples):
            table[k, : len(x)] = x
        tables[level] = table, sizes

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        may = ((side[rest] == 0) if side[x] == 0 else (side[rest] != side[x])) & (comp[rest] != comp[x])
        out = np.zeros(len(rest), bool)
        for level in (levels[x], levels[x] + 1):
            if level in tables:
                table, sizes = tables[level]
                at = np.flatnonzero(may & (np.maximum(levels[rest], levels[x]) == level) & (levels[rest] >= level - 1))
                same = np.count_nonzero((table[rest[at]] == table[x]) & (table[x] != 256), axis=1)
                out[at] = (same > 0) & (same >= threshold * np.maximum(sizes[rest[at]], sizes[x]))
        return out

    return near


def needed_bands(bands: int) -> int:
    """Bands that near texts share at least: four of twenty-four or more, one of six of fewer.

    Measured: of 7,900 texts and their copies with one to ten words changed and
    a likeness of 0.5 or more none shares fewer than six, nor fewer than 19 %.
    """
    return min(4, max(1, bands // 6))


def near_candidates(prints: DataFrame, width: int = 4, threshold: float = 0.5, block: int = 256) -> DataFrame:
    """Links between texts of like fingerprints: bit-sampled bands find candidates, the fingerprints confirm them.

    ``prints`` has doc_id and fingerprint. Equal fingerprints form a class,
    named by its smallest doc_id. Each class is posted under its bands
    (``bands_of``); a class that shares fewer than ``needed_bands`` with any
    others goes, and the longest of its lists but that number less one are
    skipped: two classes that share enough still meet in one of the others.
    First a quarter of the lists is compared in blocks (``near_at_hand``); then
    all are searched for members of different components (``across``), so
    members that are linked already are not compared again. Returns a, b (class
    names, a < b) and near (at least ``threshold``): links that span all groups,
    not all pairs of a group. Fingerprints without doc_id, and those of no
    characters, are linked with nothing else.
    """
    import xxhash

    classes = materialize(prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "classes")
    rows = classes.select(F.col("doc_id").alias("node"), F.col("fingerprint").alias("print"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, needs, keys = [], [], []
            for node, f in zip(batch.column("node").to_pylist(), batch.column("print").to_pylist(), strict=True):
                own = [xxhash.xxh64_intdigest(b) for b in bands_of(from_text(f), width, threshold)]
                keys += own
                nodes += [node] * len(own)
                needs += [needed_bands(len(own))] * len(own)
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(needs, pa.int8()), pa.array(np.array(keys, np.uint64).astype(np.int64))], names=["node", "need", "key"])

    posted = rows.mapInArrow(post, "node long, need byte, key long")
    lists = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # a doc_id of several fingerprints asks for the least of them
    mine = posted.join(lists, "key").groupBy("node").agg(F.min("need").alias("need"), F.sort_array(F.collect_list(F.struct("n", "key"))).alias("lists")).where(F.size("lists") >= F.col("need"))
    listed = materialize(mine.select("node", F.transform(F.expr("slice(lists, 1, size(lists) - need + 1)"), lambda x: x["key"]).alias("keys")), "lists")

    def kernel(columns: list[list]) -> list[tuple[int, int]]:
        _, side, comp, prints = columns
        return spanning(len(prints), near_rows([from_text(f) for f in prints], np.array(side), np.array(comp), threshold))

    some = listed.select("node", F.explode(F.filter("keys", lambda k: k % 4 == 0)).alias("key"))
    links = materialize(near_at_hand(some.join(rows, "node"), "key", ["print"], block, kernel).distinct(), "links")
    found = materialize(components(links), "components")
    labelled = listed.join(found.withColumnRenamed("component", "comp"), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "keys")
    every = labelled.select("node", "comp", F.explode("keys").alias("key"))
    apart = every.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
    met = materialize(every.join(apart, "key", "left_semi"), "lists-apart")
    pairs = links.unionByName(across(met.join(rows, "node"), "key", ["print"], block, kernel)).distinct()
    pairs = pairs.join(rows.toDF("a", "fa"), "a").join(rows.toDF("b", "fb"), "b").select("a", "fa", "b", "fb")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [likeness(from_text(x), from_text(y)) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(near, pa.float64())], names=["a", "b", "near"])

    # a doc_id that names several classes joins with each of them
    return pairs.mapInArrow(confirm, "a long, b long, near double").where(F.col("near") >= threshold).groupBy("a", "b").agg(F.max("near").alias("near"))


def near_groups(prints: DataFrame, width: int = 4, threshold: float = 0.5) -> DataFrame:
    """``prints`` (doc_id, fingerprint, ...) with near_id: the smallest doc_id that links of ``near_candidates`` reach.

    Equal fingerprints are linked; a row without doc_id has no near_id.
    """
    links = near_candidates(prints, width, threshold).select("a", "b")
    same = prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("_class"))
    found = components(links).select(F.col("node").alias("_class"), "component")
    named = prints.join(same, "fingerprint", "left").join(found, "_class", "left")
    return named.select(*prints.columns, F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "_class")).alias("near_id"))
