"""N-gram Jaccard join by T-occurrence search; exact, no sketch of a set decides anything.

A text's set are the hashes of its word n-grams. Two sets of sizes n and m are
linked from an overlap of T = ceil(share * (n + m) / (100 + share)), so at least
``least(n)`` = ceil(share * n / 100) of a set's own inverted lists must hold its
partner.

1. Equal sets are one class at once. Each class posts the ``posted(n)`` smallest
   hashes of its set, all but ``least(n)`` and ``spare(n)`` more; as all sets
   are cut in one order, linked sets share at least ``spare`` of the smaller
   one's posted hashes. A class needs that many lists with others in them and
   skips its longest lists, one fewer than it needs: two linked classes still
   meet in one of the rest. Lists with the same members are one list.
2. The members of a list meet in blocks of bounded size (``minhash``'s
   near-at-hand blocks, then across components, so that copies grow together at
   a cost in proportion to their number and nothing is left out). There they
   show which of some 3 n ranges of hashes they have any in; a range that only
   one of two sets is in holds something that the other lacks, which bounds what
   they can have in common, and pairs whose bound reaches T are candidates.
3. Groups of candidates are searched on their full sets, in blocks of the same
   kind, by DivideSkip: of the inverted lists of a set the longest ones are put
   aside, the short ones are merged on a heap, and members that occur often
   enough to reach the overlap are looked up in the long lists by binary search.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thalweg.llm.common import apart as materialize
from thalweg.llm.common import map_arrow, text_rows
from thalweg.llm.minhash import Kernel, _may_meet, connected, full_sets, labelled, same_ids, shingles, spanning

#: Weight of the long lists' binary searches against the short lists' merge, as the method's authors measured it.
MU = 0.0085


def least(n, share: int):
    """Overlap that a set of size ``n`` has with any set it is linked with (numbers or arrays)."""
    return -(-share * n // 100)


def overlap(n, m, share: int):
    """Overlap from which sets of sizes ``n`` and ``m`` are linked."""
    return -(-share * (n + m) // (100 + share))


def spare(n):
    """Posted hashes beyond those that must be posted; grows with the size."""
    return 1 + n // 20


def posted(n: int, share: int) -> int:
    return n - least(n, share) + spare(n)


class Lists:
    """Inverted lists of the sets of a block: for each value the places of the sets that hold it, in order."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(x) for x in sets])
        _, value = np.unique(np.concatenate(sets), return_inverse=True)
        self.own = np.split(value, np.cumsum(sizes)[:-1])
        self.length = np.bincount(value)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.members = np.repeat(np.arange(len(sets)), sizes)[np.argsort(value, kind="stable")]

    def _read(self, lists: np.ndarray, alive: np.ndarray) -> list[list[int]]:
        """The members of ``lists`` that are alive, list by list."""
        n = self.length[lists]
        at = np.repeat(self.begin[lists] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        members, which = self.members[at], np.repeat(np.arange(len(lists)), n)
        stay = alive[members]
        ends = np.cumsum(np.bincount(which[stay], minlength=len(lists)))
        return [x.tolist() for x in np.split(members[stay], ends[:-1]) if len(x)]

    def search(self, x: int, t: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the sets among ``alive`` that share at least ``t`` values with set ``x``, and how many."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = self.own[x][self.length[self.own[x]] > 1]
        if len(lists) < t:
            return none
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        aside = min(t - 1, int(t / (MU * math.log2(int(self.length[lists[-1]])) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        counted = [(y, sum(1 for _ in same)) for y, same in groupby(heapq.merge(*self._read(short, alive)))]
        counted = [c for c in counted if c[1] >= t - aside]
        if not counted:
            return none
        found, counts = (np.array(c, np.int64) for c in zip(*counted, strict=True))
        for k in long:
            members = self.members[self.begin[k] : self.begin[k + 1]]
            at = np.searchsorted(members, found)
            counts = counts + (members[np.minimum(at, len(members) - 1)] == found)
        enough = counts >= t
        return found[enough], counts[enough]


def marks(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of 2**b equal ranges of 64-bit hashes, two to four times as many as hashes: is one of them there?"""
    bits = max(6, (2 * len(hashes) - 1).bit_length())
    there = np.zeros(1 << bits, bool)
    there[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(there)


def _halved(rows: np.ndarray) -> np.ndarray:
    """Marks of ranges twice as wide."""
    bits = np.unpackbits(rows, axis=1)
    return np.packbits(bits[:, 0::2] | bits[:, 1::2], axis=1)


def bound_kernel(share: int) -> Kernel:
    """Pairs of a block whose marks allow the overlap, as a spanning forest; the columns end with sizes and marks.

    Each range that is marked in one set only holds a hash that the other lacks.
    Linked sets differ in size by less than a factor of two, so their ranges are
    the same or twice as wide.
    """

    def kernel(columns: list[list]) -> list[tuple[int, int]]:
        _, side, comp, sizes, packed = columns
        side, comp, n = np.array(side), np.array(comp), np.array(sizes)
        level = np.array([len(c) for c in packed])
        at, own, half = np.zeros(len(n), np.int64), {}, {}
        for v in np.unique(level):
            of = np.flatnonzero(level == v)
            at[of] = np.arange(len(of))
            own[v] = np.frombuffer(b"".join(packed[i] for i in of), np.uint8).reshape(len(of), v)
            half[v] = _halved(own[v])

        def near(x: int, rest: np.ndarray) -> np.ndarray:
            can = _may_meet(side, comp, x, rest) & (100 * n[rest] >= share * n[x]) & (100 * n[x] >= share * n[rest])
            hit, v = np.zeros(len(rest), bool), level[x]
            for u, mine, theirs in ((v, own, own), (2 * v, own, half), (v // 2, half, own)):
                of = np.flatnonzero(can & (level[rest] == u))
                if len(of):
                    a, b = mine[v][at[x]], theirs[u][at[rest[of]]]
                    lacks = lambda p, q: np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64)
                    most = np.minimum(n[x] - lacks(a, b), n[rest[of]] - lacks(b, a))
                    hit[of] = most >= overlap(n[x], n[rest[of]], share)
            return hit

        return spanning(len(n), near)

    return kernel


def search_kernel(share: int) -> Kernel:
    """Links of a block of full sets, as a spanning forest, each found by the search."""

    def kernel(columns: list[list]) -> list[tuple[int, int]]:
        _, side, comp, sets = columns
        side, comp = np.array(side), np.array(comp)
        sets = [np.frombuffer(x, np.uint64) for x in sets]
        n = np.array([len(x) for x in sets])
        lists = Lists(sets)

        def near(x: int, rest: np.ndarray) -> np.ndarray:
            alive = np.zeros(len(n), bool)
            alive[rest] = _may_meet(side, comp, x, rest)
            found, counts = lists.search(x, int(least(n[x], share)), alive)
            hit = np.zeros(len(n), bool)
            hit[found[counts >= overlap(n[x], n[found], share)]] = True
            return hit[rest]

        return spanning(len(n), near)

    return kernel


def _sets(docs: DataFrame, width: int, share: int) -> DataFrame:
    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        sizes, names, heads = [], [], []
        for text in batch.column("text").to_pylist():
            x = shingles(text, width)
            sizes.append(len(x))
            names.append(xxhash.xxh128_digest(x.tobytes()) if len(x) else None)
            heads.append(x[: posted(len(x), share)].view(np.int64) if len(x) else None)
        return pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(heads, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set", "posted"])

    return map_arrow(text_rows(docs), look, "doc_id long, n_shingles long, set binary, posted array<bigint>", most_bytes=4 << 20, cache="words")


def _needed_lists(n: Column, share: int) -> Column:
    """``spare`` of the smallest set that one of size ``n`` can be linked with."""
    return F.lit(1) + F.floor(F.ceil(n * F.lit(share) / F.lit(100)) / F.lit(20))


def _lists_of(classes: DataFrame, share: int) -> DataFrame:
    """The keys (node, keys) under which each class must meet others."""
    # counted where they are ranked, so postings are shuffled once
    rows = classes.select("node", F.explode("posted").alias("key")).withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n > 1")
    size = classes.groupBy("node").agg(_needed_lists(F.min("n"), share).cast("int").alias("needed"))
    ranked = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("lists"))  # at most what the node posted
    ranked = ranked.join(size, "node").where(F.size("lists") >= F.col("needed"))
    left = materialize(ranked.select("node", F.explode(F.slice("lists", F.lit(1), F.size("lists") - F.col("needed") + 1)["key"]).alias("key")), "lists")
    same = left.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("a"), F.max("node").alias("b"))
    same = same.where("a <> b").select("key", F.xxhash64("n", "x", "a", "b").alias("members"))
    return materialize(left.join(same, "key").groupBy("node").agg(F.collect_set("members").alias("keys")), "member-lists")


def ngram_join(docs: DataFrame, width: int = 5, share: int = 80, block: int = 512) -> DataFrame:
    """Components of texts whose n-gram sets have 100 * intersection >= share * union, no link left out.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept
    (doc_id = component_id), one row for each input row. Texts without words
    have the empty set and are linked with nothing; texts with fewer than
    ``width`` words have one n-gram, the whole sequence. Rows that repeat a
    doc_id count as one document: each keeps its own n_shingles, and their links
    are shared. Rows without doc_id are linked with nothing and kept. An empty
    table gives no rows; ties do not arise, links being a threshold. N-grams are
    compared as 64-bit hashes, equal sets by a 128-bit hash; ``share`` is above
    50. Memory follows a block of sets, 8 bytes an n-gram. Other columns are not looked at.
    """
    if not 50 < share <= 100:
        raise ValueError("share is a percentage above 50")
    every = materialize(_sets(docs, width, share), "sets")
    linked = every.where("set is not null and doc_id is not null")
    classes = materialize(linked.groupBy("set").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("posted").alias("posted")), "classes")
    listed = _lists_of(classes, share)
    sets = full_sets(docs, width, listed)

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
        return pa.record_batch([batch.column("node"), pa.array([len(x) for x in found], pa.int64()), pa.array([marks(x).tobytes() for x in found], pa.binary())], names=["node", "n", "marks"])

    signed = materialize(map_arrow(sets, mark, "node long, n long, marks binary"), "marks")
    named = every.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set")).alias("set")).join(classes.select("set", "node"), "set", "left")
    of = lambda nodes: sets.join(nodes.select("node"), "node", "left_semi")
    return labelled(named, connected(listed, signed, bound_kernel(share), of, search_kernel(share), same_ids(named), block))
