"""Near duplicates by an inverted join over MinHash signature coordinates.

1. Each text gets the set of its word shingles (as 64-bit hashes), a hash of
   the whole set and a signature of ``COORDINATES`` minima. Equal sets form a
   class at once; the rest works on classes.
2. Classes are posted under each (coordinate, value) of the first ``POSTED``
   coordinates; values that stand alone cannot match and go. A class needs
   ``MATCH_POSTED`` shared values to match another, so it stays only if it has as many
   values left, and of its posting lists, ordered by length, it skips the
   ``MATCH_POSTED - 1`` longest: two classes that match still meet in one of the others.
3. Near at hand: each list is cut into blocks of bounded size by a hash, a few
   of its members (leaders) stand in all of its blocks, and inside a block the
   signatures are compared; pairs with at least ``MATCH_ALL`` equal coordinates
   are candidates. The connected candidates are confirmed on their full shingle
   sets in blocks of the same kind. Every row is sent about once, and the copies
   of one text grow together, because blocks share leaders and lists are cut
   differently.
4. Across: lists and candidate groups that did not fit into one block are
   compared once more, but only members of different confirmed components: the
   largest component of a list against the rest, and the rest against itself.
   No pair that could match is left out; a list that is one component costs
   nothing, one of n members with r outside its largest component n + r * n /
   block rows.
5. The components of all confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import apart as materialize
from thalweg.llm.common import give_back, keeps, map_arrow, only, partitions, small_batches, space_words, text_rows
from thalweg.llm.components import components

COORDINATES = 64
POSTED = 32
_A = np.random.default_rng(20240607).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_HASHES: dict[bytes, int] = {}
keeps("words", _HASHES.clear)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    known = _HASHES
    if len(known) > 150_000:
        known.clear()
    get, make = known.get, xxhash.xxh64_intdigest
    out = list(map(get, words))
    if None in out:
        for k, (w, v) in enumerate(zip(words, out, strict=True)):
            if v is None:
                out[k] = known[w] = make(w)
    return np.array(out, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole sequence if it is shorter; none without words."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    size = min(width, len(h))
    n = len(h) - size + 1
    x = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        x = _mix(x * _M[0] + h[k : k + n])
    return np.unique(x)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of ``COORDINATES`` multiplicative hashes, 32 bits each."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 4096):
        part = (hashes[at : at + 4096] * _A[:, None]) >> np.uint64(32)
        out = np.minimum(out, part.min(axis=1).astype(np.uint32))
    return out


def needed(coordinates: int, share: float) -> int:
    """Equal coordinates that pairs at the threshold fall short of at most once in 10**7, by the exact binomial tail."""
    short, need = 0.0, 0
    while need < coordinates:
        short += comb(coordinates, need) * share**need * (1 - share) ** (coordinates - need)
        if short > 1e-7:
            break
        need += 1
    return max(1, need)


def _sketch(docs: DataFrame, width: int) -> DataFrame:
    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        sizes, sets, signs = [], [], []
        for text in batch.column("text").to_pylist():
            x = shingles(text, width)
            sizes.append(len(x))
            sets.append(xxhash.xxh128_digest(x.tobytes()) if len(x) else None)
            signs.append(signature(x).tobytes() if len(x) else None)
        return pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set", "sign"])

    return map_arrow(text_rows(docs), look, "doc_id long, n_shingles long, set binary, sign binary", most_bytes=4 << 20, cache="words")


def _pair_of(own: Column, other: Column) -> Column:
    """The two blocks, smaller first, as one number, for up to a million blocks."""
    return F.least(own, other).cast("long") * F.lit(1 << 20) + F.greatest(own, other)


Kernel = Callable[[list[list]], list[tuple[int, int]]]


def _run_groups(met: DataFrame, payload: list[str], kernel: Kernel) -> DataFrame:
    """Links (a, b) that ``kernel`` finds inside each group: ``met`` has _key, _pair, node, _side, _comp and the payload.

    The kernel gets the columns node, _side, _comp and payload of a group and
    returns pairs of positions. Side 0 meets all, sides 1 and 2 each other.
    """
    spark = met.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, held = None, []

        def flush() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            pairs = kernel([list(c) for c in zip(*held, strict=True)])
            ids = {(min(held[x][0], held[y][0]), max(held[x][0], held[y][0])) for x, y in pairs if held[x][0] != held[y][0]}
            return pa.record_batch([pa.array([i for i, _ in ids], pa.int64()), pa.array([j for _, j in ids], pa.int64())], names=["a", "b"]) if ids else None

        only()
        for batch in small_batches(batches, 1 << 20):
            columns = [batch.column(c).to_pylist() for c in ("_key", "_pair", "node", "_side", "_comp", *payload)]
            for k, p, *row in zip(*columns, strict=True):
                if (k, p) != mark:
                    if (out := flush()) is not None:
                        yield out
                    mark, held = (k, p), []
                held.append(tuple(row))
        if (out := flush()) is not None:
            yield out
        held.clear()
        give_back()

    return met.repartition(partitions(spark), F.xxhash64("_key", "_pair")).sortWithinPartitions("_key", "_pair", "node").select("_key", "_pair", "node", "_side", "_comp", *payload).mapInArrow(run, "a long, b long")


def near_at_hand(rows: DataFrame, key: str, payload: list[str], block: int, kernel: Kernel) -> DataFrame:
    """Links among the rows (key, node, payload) of each key, inside blocks of about ``block`` rows and some leaders.

    A key's rows are dealt to its blocks by a hash; about a quarter of a block
    more, the key's leaders, stand in all of them. A key of at most ``block``
    rows is one block and compared in full.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_cut", F.ceil(F.col("_n") / F.lit(block)).cast("long"))
    placed = rows.join(sizes, key)
    own = F.pmod(F.xxhash64("node", key), F.col("_cut"))
    leads = (F.col("_cut") > 1) & (F.pmod(F.xxhash64(F.lit(1), "node", key), F.col("_n")) < block // 4)
    at = F.explode(F.when(leads, F.sequence(F.lit(0).cast("long"), F.col("_cut") - 1)).otherwise(F.array(own)))
    met = placed.select(F.col(key).alias("_key"), at.alias("_pair"), "node", F.lit(0).alias("_side"), F.col("node").alias("_comp"), *payload)
    return _run_groups(met, payload, kernel)


def across(rows: DataFrame, key: str, payload: list[str], block: int, kernel: Kernel) -> DataFrame:
    """Links among the rows (key, node, comp, payload) of each key between different ``comp``, all of them.

    The key's largest component is cut into blocks that meet the blocks of the
    rest; these meet each other. Only keys with more than one component count.
    """
    parts = rows.groupBy(key, "comp").agg(F.count("*").alias("_m"))
    tops = parts.groupBy(key).agg(F.max_by("comp", F.struct("_m", "comp")).alias("_top"), F.max("_m").alias("_g"), F.sum("_m").alias("_n")).where("_n > _g")
    cut = lambda n: F.ceil(n / F.lit(block)).cast("long")
    placed = rows.join(tops, key).withColumn("_cg", cut(F.col("_g"))).withColumn("_cr", cut(F.col("_n") - F.col("_g"))).withColumn("_main", F.col("comp") == F.col("_top"))
    own = F.pmod(F.xxhash64("node", key), F.when(F.col("_main"), F.col("_cg")).otherwise(F.col("_cr")))
    placed = placed.withColumn("_own", own)
    kept = [F.col(key).alias("_key"), "node", F.col("comp").alias("_comp"), *payload]
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("_other")
    rest = placed.where("not _main")
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    among = rest.select("*", to("_cr")).select(*kept, _pair_of(F.col("_own"), F.col("_other")).alias("_pair"), side.alias("_side"))
    # the rest's blocks against the main component's, in numbers of their own
    cross = lambda r, m: (-1 - r.cast("long") * F.lit(1 << 20) - m.cast("long")).alias("_pair")
    left = rest.select("*", to("_cg")).select(*kept, cross(F.col("_own"), F.col("_other")), F.lit(1).alias("_side"))
    right = placed.where("_main").select("*", to("_cr")).select(*kept, cross(F.col("_other"), F.col("_own")), F.lit(2).alias("_side"))
    return _run_groups(among.unionByName(left).unionByName(right), payload, kernel)


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest: ``near(x, rest)`` tells which of the places ``rest`` are linked with x."""
    left, joins = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            found, left = left[hit], left[~hit]
            joins += [(x, int(y)) for y in found]
            queue += found.tolist()
    return joins


def _may_meet(side: np.ndarray, comp: np.ndarray, x: int, rest: np.ndarray) -> np.ndarray:
    return ((side[rest] == 0) if side[x] == 0 else (side[rest] != side[x])) & (comp[rest] != comp[x])


def candidate_kernel(match: int) -> Kernel:
    def kernel(columns: list[list]) -> list[tuple[int, int]]:
        _, side, comp, signs = columns
        s = np.frombuffer(b"".join(signs), np.uint32).reshape(len(signs), -1)
        side, comp = np.array(side), np.array(comp)
        return spanning(len(s), lambda x, rest: (np.count_nonzero(s[rest] == s[x], axis=1) >= match) & _may_meet(side, comp, x, rest))

    return kernel


def confirm_kernel(share: int, dense: int = 8_000_000) -> Kernel:
    """Links with 100 * intersection >= share * union, as a spanning forest; intersections are exact."""

    def kernel(columns: list[list]) -> list[tuple[int, int]]:
        _, side, comp, sets = columns
        side, comp = np.array(side), np.array(comp)
        sets = [np.frombuffer(x, np.uint64) for x in sets]
        n = len(sets)
        sizes = np.array([len(x) for x in sets])
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), sizes)
        shared = np.bincount(place, minlength=len(values)) > 1  # of the values in at least two sets
        column = np.cumsum(shared) - 1
        keep = shared[place]
        row, column, width = row[keep], column[place[keep]], int(shared.sum())
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((n, n), np.float32)
        step = max(1, dense // max(1, n))
        for at in range(0, width, step):
            a, b = np.searchsorted(column, [at, at + step])
            m = np.zeros((n, min(step, width - at)), np.float32)
            m[row[a:b], column[a:b] - at] = 1
            common += m @ m.T
        ok = 100 * common.astype(np.float64) >= share * (sizes[:, None] + sizes[None, :] - common)
        return spanning(n, lambda x, rest: ok[x, rest] & _may_meet(side, comp, x, rest))

    return kernel


def _label(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (node, ...) with comp, the node's component; its own name where it has none."""
    return rows.join(found.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def same_ids(named: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of ids that repeat with other texts; ``named`` has doc_id and node."""
    first = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last").select("doc_id", "a")
    return named.join(first, "doc_id").select("a", F.col("node").alias("b"))


def labelled(named: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of the rows (doc_id, n_shingles, node)."""
    component = F.coalesce("component", "node", "doc_id")
    return named.join(found, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def likely(rows: DataFrame, nodes: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """The ``rows`` whose doc_id may be among ``nodes``: all that are, and few others.

    A bit map of about eight bits a node, at most 32 MB, is broadcast in pieces
    of 4 KB, so that rows that no node needs are not shuffled. Beyond some
    hundred million nodes it lets more and more rows through, none too few.
    """
    bits = min(most_bits, max(1 << 15, 1 << (8 * nodes.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits)) + 1
    maps = nodes.select(place(F.col("node")).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("_at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("_bits"))
    at = F.bitmap_bit_position(place(F.col("doc_id")))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_at", F.bitmap_bucket_number(place(F.col("doc_id")))).join(F.broadcast(maps), "_at")  # at most ``most_bits``
    return met.where((F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))) % 2 == 1)).select(*rows.columns)


def full_sets(docs: DataFrame, width: int, nodes: DataFrame) -> DataFrame:
    """(node, hashes): the shingles of the texts of ``nodes``, 8 bytes each."""

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, width) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("node"), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "hashes"])

    nodes = nodes.select("node")
    texts = likely(text_rows(docs), nodes).join(nodes.withColumnRenamed("node", "doc_id"), "doc_id").withColumnRenamed("doc_id", "node")
    return materialize(map_arrow(texts, look, "node long, hashes binary", cache="words").where("length(hashes) > 0"), "sets")


def connected(listed: DataFrame, signed: DataFrame, signs: Kernel, sets_of: Callable[[DataFrame], DataFrame], confirm: Kernel, known: DataFrame, block: int) -> DataFrame:
    """Components (node, component) of the links between nodes that meet under a key, and of the ``known`` ones.

    ``listed`` has the keys of each node, ``signed`` what the kernel ``signs``
    compares to find candidates (steps 3 to 5 of the module); ``confirm`` judges
    candidates on their full sets, which ``sets_of`` gives.
    """
    payload = [c for c in signed.columns if c != "node"]
    prefix = materialize(listed.join(signed, "node").select("node", F.explode("keys").alias("key"), *payload), "prefix")
    few = max(2, block // 4)
    edges = materialize(near_at_hand(prefix, "key", payload, block, signs), "candidate-links")
    candidates = materialize(components(edges), "candidates")

    sets = sets_of(candidates)
    grouped = sets.join(candidates, "node")
    links = materialize(near_at_hand(grouped, "component", ["hashes"], few, confirm), "links").unionByName(known)
    found = components(links)

    # what did not fit into one block: the members of different components meet as well
    hot = prefix.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key")
    wide = grouped.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > few).select("component")
    if hot.isEmpty() and wide.isEmpty():
        return found
    found = materialize(found, "first-components")
    members = _label(listed, found).select("node", "comp", F.explode("keys").alias("key"))
    apart = members.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b")).where((F.col("n") > block) & (F.col("a") != F.col("b"))).select("key")
    rows = materialize(members.join(apart, "key", "left_semi").join(signed, "node"), "lists-apart")
    more = materialize(across(rows, "key", payload, block, signs), "candidate-links")
    grown, again = candidates, wide
    if not more.isEmpty():
        grown = materialize(components(edges.unionByName(more)), "candidates")
        sets = sets.unionByName(sets_of(grown.join(candidates, "node", "left_anti")))
        old = candidates.select("node", F.col("component").alias("old"))
        parts = sets.select("node").join(grown, "node").join(old, "node", "left").select("component", F.coalesce("old", "node").alias("old"))
        again = parts.groupBy("component").agg(F.min("old").alias("a"), F.max("old").alias("b"), F.count("*").alias("n")).where((F.col("a") != F.col("b")) | (F.col("n") > few)).select("component")
    rows = _label(sets.join(grown.join(again, "component", "left_semi"), "node"), found)
    return components(links.unionByName(across(rows, "component", ["hashes"], few, confirm)))


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, block: int = 512) -> DataFrame:
    """Components of texts whose shingle sets have 100 * intersection >= share * union.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept
    (doc_id = component_id), one row for each input row. Texts without words
    have the empty set and are linked with nothing. Rows that repeat a doc_id
    count as one document: each keeps its own n_shingles, and their links are
    shared. Rows without doc_id are linked with nothing and kept. An empty table
    gives no rows; ties do not arise, links being a threshold. Shingles are
    compared as 64-bit hashes, equal sets by a 128-bit hash.
    """
    match_posted, match_all = needed(POSTED, share / 100), needed(COORDINATES, share / 100)
    sketch = materialize(_sketch(docs, width), "sketch")
    # equal sets are one class; rows of one doc_id are one node
    linked = sketch.where("set is not null and doc_id is not null")
    classes = materialize(linked.groupBy("set").agg(F.min("doc_id").alias("node"), F.min("sign").alias("sign")), "classes")
    posted = classes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(POSTED - 1)), lambda k: F.substring(F.col("sign"), k * 4 + 1, F.lit(4)))).alias("at", "value")).select("node", F.concat(F.hex("value"), F.lit(":"), F.col("at")).alias("text"))
    posted = posted.select("node", F.xxhash64("text").alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    kept = posted.join(lists, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("lists"))  # at most POSTED each
    kept = kept.where(F.size("lists") >= match_posted)
    listed = materialize(kept.select("node", F.transform(F.slice("lists", F.lit(1), F.size("lists") - (match_posted - 1)), lambda x: x["key"]).alias("keys")), "lists")
    signs, confirm = candidate_kernel(match_all), confirm_kernel(share)
    named = sketch.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set")).alias("set")).join(classes.select("set", "node"), "set", "left")
    found = connected(listed, classes.select("node", "sign"), signs, lambda nodes: full_sets(docs, width, nodes), confirm, same_ids(named), block)
    return labelled(named, found)
