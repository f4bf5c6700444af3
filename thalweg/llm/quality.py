"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import crc_mod, map_arrow, text_rows

HASHED = 4096
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line feed, 6 sign, 7 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 7 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6


def vector_of(text: str) -> np.ndarray:
    """Hashed byte trigrams by the root of their counts, at unit length, then the text's make-up at a like weight.

    The make-up: shares of the character classes, of distinct words among all,
    of words like the word before, and the mean word length.
    """
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(HASHED + 11, np.float32)
    if len(b) >= 3:
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x = np.sqrt(np.bincount(h >> np.uint32(20), minlength=HASHED).astype(np.float32))
        out[:HASHED] = x / np.linalg.norm(x)
    if len(b):
        out[HASHED : HASHED + 8] = np.bincount(_CLASS[b], minlength=8) / len(b)
    words = raw.split()
    if words:
        out[HASHED + 8] = len(set(words)) / len(words)
        out[HASHED + 9] = sum(map(bytes.__eq__, words[1:], words)) / len(words)
        out[HASHED + 10] = min(1.0, len(raw) / len(words) / 20)
    return out


def train(docs: DataFrame, labels: DataFrame, each: int = 2048, rank: int = 64, fold: int = 3, held: int = 1, seed: int = 7) -> dict:
    """Projection and labelled vectors from rows whose crc32(doc_id) mod ``fold`` is not ``held``.

    The labelled rows are a bounded sample, at most ``each`` of either label,
    taken by a hash of doc_id. The latent space is a truncated singular value
    decomposition of their trigram vectors (randomised range finder).
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    ids = None
    for q in (0, 1):
        part = usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        ids = part if ids is None else ids.unionByName(part)
    rows = text_rows(docs).join(F.broadcast(ids), "doc_id")  # bounded by 2 * each

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array([vector_of(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "quality", "v"])

    got = map_arrow(rows, vectors, "doc_id long, quality int, v binary").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(got["v"].to_pylist()), np.float16).reshape(len(order), HASHED + 11)[order].astype(np.float32)
    y = got["quality"].to_numpy()[order].astype(np.float32)
    if not len(x):
        return {"project": np.zeros((HASHED, 1), np.float32), "refs": np.zeros((0, 12), np.float32), "y": y, "scale": np.ones(11, np.float32), "mean": np.zeros(11, np.float32)}
    hashed, make = x[:, :HASHED], x[:, HASHED:]
    rank = min(rank, len(x))
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(hashed @ rng.standard_normal((HASHED, rank + 16)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(hashed @ (hashed.T @ q))[0]
    _, s, vt = np.linalg.svd(q.T @ hashed, full_matrices=False)
    model = {"project": np.ascontiguousarray(vt[:rank].T), "mean": make.mean(0), "scale": 1 / (make.std(0) + 1e-3), "y": y}
    return model | {"refs": latent(x, model)}


def latent(x: np.ndarray, model: dict) -> np.ndarray:
    """Latent-semantic vectors at unit length: the projected trigrams and the standardised make-up, at equal weight."""
    z = x[:, :HASHED] @ model["project"]
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-6)
    m = (x[:, HASHED:] - model["mean"]) * model["scale"]
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1.0)
    out = np.hstack([z, m])
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def vote(vectors: np.ndarray, refs: np.ndarray, y: np.ndarray, k: int = 15, power: float = 8.0) -> np.ndarray:
    """Share of label 1 among the k nearest by cosine, each neighbour weighing its similarity to the given power."""
    if not len(refs):
        return np.full(len(vectors), 0.5)
    k = min(k, len(refs))
    near = vectors @ refs.T
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, top, 1).astype(np.float64), 0) ** power + 1e-9
    return np.clip((weight * y[top]).sum(1) / weight.sum(1), 0.0, 1.0)


def score_quality(docs: DataFrame, model: dict, fold: int = 3, held: int = 1, block: int = 256) -> DataFrame:
    """Score every whole text: doc_id, held_out, score in [0, 1], predicted (score >= 0.5).

    Cosine products with all labelled vectors are computed exactly, in blocks
    of documents. One row for each input row, repeated rows included and with
    equal scores, no shuffle; a null or empty text has the vector of no trigram;
    without any labelled row all scores are 0.5; an empty table gives no rows.
    Of equal cosines at the last place the same ones are taken on every run.
    Texts of any length are scored whole; those much longer than all labelled
    ones have no near neighbours, and their score means little.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * each vectors

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        texts, values = batch.column("text").to_pylist(), []
        for at in range(0, len(texts), block):
            if len(m["refs"]):
                x = np.stack([vector_of(t) for t in texts[at : at + block]])
                values.append(vote(latent(x, m), m["refs"], m["y"]))
            else:
                values.append(np.full(len(texts[at : at + block]), 0.5))
        v = np.concatenate(values)
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(v, pa.float64()), pa.array((v >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = text_rows(docs, (crc_mod(F.col("doc_id"), fold) == held).alias("held_out"))
    return map_arrow(rows, score, "doc_id long, held_out boolean, score double, predicted int")
