"""Token-ID files of patched frame-of-reference blocks.

A file image is a header, the document table, the block index and the blocks.
Every block holds 128 ids: the block's minimum is subtracted, the differences
are packed at the width that a percentile of them needs, and what does not fit
goes to an exception list (place in the block, high part). The index holds the
byte at which each block starts, so one document can be read alone.

The images are kept as rows (shard, segment, first id, payload) of a Parquet
dataset, so writing them works on any store that Spark can write to and follows
Spark's commit protocol when tasks run twice; ``export_files`` writes them as
plain files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import give_back, only, partitions, scratch_path, small_batches, text_rows
from thalweg.llm.tokens import _encoder, encode_words

BLOCK = 128
MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIQIQ")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below 2**width as 2*width little-endian 64-bit words a row."""
    out = np.zeros((2 * width, len(values)), np.uint64)
    columns = np.ascontiguousarray(values.T)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    mask = np.uint64((1 << width) - 1)
    columns = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, len(words)), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        v = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (columns[word + 1] << np.uint64(64 - shift))
        out[i] = v & mask
    return np.ascontiguousarray(out.T)


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(v.astype(np.float64) + 1)).astype(np.int64)


def encode_ids(ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, bytes]:
    """The start of each block (one more than there are blocks) and the blocks' bytes.

    A block: minimum (u32), width (u8), exceptions (u8), packed words, places of
    the exceptions (u8 each), high parts (u32 each). The last block is filled up
    with its last id; the number of ids stands in the header.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(1, np.uint64), b""
    v = np.empty(blocks * BLOCK, np.uint64)
    v[:n] = ids
    v[n:] = v[n - 1]
    v = v.reshape(blocks, BLOCK)
    low = v.min(1)
    v -= low[:, None]
    ranked = np.partition(v, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))]
    width = np.minimum(_bits(ranked), 32)
    over = v >> width[:, None].astype(np.uint64)
    extra = np.count_nonzero(over, axis=1)
    size = 6 + 16 * width + 5 * extra
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(starts[-1]), np.uint8)
    at = starts[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at + 4], out[at + 5] = width, extra
    for w in np.unique(width):
        if w:
            k = np.flatnonzero(width == w)
            packed = _pack(v[k] & np.uint64((1 << int(w)) - 1), int(w)).astype("<u8").view(np.uint8).reshape(len(k), -1)
            out[(at[k] + 6)[:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(extra)])[row]
        base = at[row] + 6 + 16 * width[row]
        out[base + nth] = place
        high = over[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + extra[row] + 4 * nth)[:, None] + np.arange(4)] = high
    return starts.astype(np.uint64), out.tobytes()


def decode_ids(starts: np.ndarray, body: np.ndarray, n: int) -> np.ndarray:
    """The ids of the blocks that start at ``starts[:-1]`` of ``body``."""
    blocks = len(starts) - 1
    if not blocks:
        return np.zeros(0, np.uint32)
    at = starts[:-1].astype(np.int64)
    low = body[at[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, extra = body[at + 4].astype(np.int64), body[at + 5].astype(np.int64)
    v = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            k = np.flatnonzero(width == w)
            v[k] = _unpack(body[(at[k] + 6)[:, None] + np.arange(16 * w)].copy().view("<u8"), int(w))
    row = np.repeat(np.arange(blocks), extra)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(extra)])[row]
        base = at[row] + 6 + 16 * width[row]
        high = body[(base + extra[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.uint64)
        v[row, body[base + nth]] |= high << width[row].astype(np.uint64)
    return (v + low[:, None].astype(np.uint64)).ravel()[:n].astype(np.uint32)


def write_image(doc_ids: list[int | None], lengths: list[int] | np.ndarray, ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """A file: header (magic, documents, ids, blocks, body bytes), document table, block index, blocks."""
    starts, body = encode_ids(ids, percentile)
    null = np.array([d is None for d in doc_ids], np.uint8)
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + np.array(lengths, "<u8").tobytes()
    return _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(starts) - 1, len(body)) + table + starts.astype("<u8").tobytes() + body


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a file."""
    magic, docs, n, blocks, size = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a PFR1 image")
    at = _HEAD.size
    doc_ids = np.frombuffer(image, "<i8", docs, at)
    null = np.frombuffer(image, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(image, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    starts = np.frombuffer(image, "<u8", blocks + 1, at)
    body = np.frombuffer(image, np.uint8, size, at + 8 * (blocks + 1))
    return [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], lengths, decode_ids(starts, body, n)


def read_document(image: bytes, k: int) -> np.ndarray:
    """The ids of the k-th document of a file, from its own blocks only."""
    _, docs, n, blocks, size = _HEAD.unpack_from(image)
    at = _HEAD.size
    ends = np.cumsum(np.frombuffer(image, "<u8", docs, at + 9 * docs).astype(np.int64))
    begin, end = (int(ends[k - 1]) if k else 0), int(ends[k])
    at += 17 * docs
    starts = np.frombuffer(image, "<u8", blocks + 1, at)
    body = np.frombuffer(image, np.uint8, size, at + 8 * (blocks + 1))
    first, last = begin // BLOCK, -(-end // BLOCK)
    ids = decode_ids(starts[first : last + 1], body, min(n, last * BLOCK) - first * BLOCK)
    return ids[begin - first * BLOCK : end - first * BLOCK]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, segment_ids: int = 1 << 18, path: str | None = None, percentile: float = 0.9) -> str:
    """Encode every text, append ``end_id`` and write the ids in ascending doc_id order; returns the dataset's path.

    The documents are dealt by ranges of doc_id and sorted inside each range
    (one shuffle of the texts). Rows with equal doc_id are ordered by their
    first 64 characters and a hash of the text, a null doc_id comes first; an id
    (or null) that many rows share is dealt over several ranges by the same
    order, rows equal in both anyhow. A segment closes at the first document end past
    ``segment_ids`` ids, so memory follows the segment or the longest document.
    A block's width holds the share ``percentile`` of its ids.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-ids")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens")
        encoder = _encoder(tokenizer, strip=True)
        shard = TaskContext.get().partitionId()
        doc_ids, lengths, parts, held, before, segment = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            image = write_image(doc_ids, np.concatenate(lengths), np.concatenate(parts), percentile)
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([image], pa.binary())], names=["shard", "segment", "first", "n_ids", "payload"])

        for batch in small_batches(batches, 4 << 20):
            ids, sizes = encode_words(batch.column("text"), encoder)
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
            ends, names, at = np.cumsum(sizes), batch.column("doc_id").to_pylist(), 0
            while at < len(names):
                begin = int(ends[at - 1]) if at else 0
                stop = min(len(names), int(np.searchsorted(ends, begin + segment_ids - held)) + 1)
                doc_ids += names[at:stop]
                lengths.append(sizes[at:stop])
                parts.append(ids[begin : ends[stop - 1]])
                held, at = held + int(ends[stop - 1]) - begin, stop
                if held >= segment_ids:
                    yield close()
                    before, segment = before + held, segment + 1
                    doc_ids, lengths, parts, held = [], [], [], 0
        if doc_ids:
            yield close()
        give_back()

    rows = text_rows(docs).select("doc_id", "text", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("mark"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", "head", "mark", F.monotonically_increasing_id())
    dealt.sortWithinPartitions("doc_id", "head", "mark", "text").select("doc_id", "text").mapInArrow(segments, "shard int, segment int, first long, n_ids long, payload binary").write.option("compression", "none").parquet(path)
    return path


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids.

    ``start`` needs the number of ids of all shards before: one number for each
    shard is summed on the driver, however many documents there are.
    """
    files = spark.read.parquet(path)
    totals = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    bases, base = {}, 0
    for shard in sorted(totals):
        bases[shard] = base
        base += totals[shard]
    shared = spark.sparkContext.broadcast(bases)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("shard", "first", "payload")}
                doc_ids, lengths, ids = read_image(row["payload"])
                ends = np.cumsum(lengths)
                starts = ends - lengths
                each = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                out = [pa.array(doc_ids, pa.int64()), pa.array(starts + shared.value[row["shard"]] + row["first"], pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.record_batch(out, names=names)

    return files.select("shard", "first", "payload").mapInArrow(rows, schema)


def export_files(spark, path: str, folder: str) -> list[str]:
    """Write every image as a plain ``shard-segment.pfr`` file of a mounted folder; returns the names."""
    import os

    os.makedirs(folder, exist_ok=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = f"{batch.column('shard')[k].as_py():06d}-{batch.column('segment')[k].as_py():06d}.pfr"
                with open(f"{folder}/{name}.part", "wb") as f:
                    f.write(batch.column("payload")[k].as_py())
                os.replace(f"{folder}/{name}.part", f"{folder}/{name}")
                yield pa.record_batch([pa.array([name])], names=["name"])

    return sorted(r[0] for r in spark.read.parquet(path).select("shard", "segment", "payload").mapInArrow(put, "name string").collect())


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, percentile: float = 0.9) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens (with the end id), ids_crc32.

    One row for each input row: repeated rows and repeated ids stay, a null or
    empty text is the end id alone, an empty table gives no rows.
    """
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, end_id, percentile=percentile))
