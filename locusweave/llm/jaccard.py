"""Near-duplicates by the Jaccard similarity of sets of word shingles: every pair at or above it is linked, no pair below.

Two sets with a similarity of s share one of the first ``n - ceil(s n) + 1`` of their shingles in any common order (prefix
filter), so sets that share none need no comparison. What is left is cut by exact bounds (sizes, and parity bitmaps, whose
differing bits never exceed the differing shingles) and then decided on the whole sets. Shingles are held as 64-bit hashes.

Documents with equal sets are one node. In a group that shares a shingle all nodes are first compared with its least one, then,
where a group of over CROWD nodes is still in several components, in PIVOTS rounds with another one each, drawn by hash;
only pairs that these links leave in different components are compared after that, so a group of n near copies costs a few n
comparisons. Texts without words share the empty set; texts of fewer words than a shingle are one shingle. Rows without a
doc_id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, components, groups, materialize, released, row_key, slices, texts_of, to_batch

#: Bits of a parity bitmap; documents that are sampled for the order of shingles, and how many must share one to put it last.
BITS, SAMPLED, OFTEN = 1024, 5000, 4
CROWD, PIVOTS = 64, 3


def shingle_sets(texts: list[bytes], words: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``words`` lower-cased words."""
    digest = xxhash.xxh64_digest
    for low, high in slices(texts):
        w = Words(texts[low:high], lower=True)
        start, end, text, first = w.start.tolist(), w.end.tolist(), w.text, w.first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            n, last = max(1, b - a - words + 1) if b > a else 0, min(words, b - a) - 1
            joined = b"".join([digest(text[i:j], 42) for i, j in zip(start[a : a + n], end[a + last : a + last + n])])
            yield np.unique(np.frombuffer(joined, ">u8").astype(np.uint64))


def prefix(shingles: np.ndarray, similarity: float, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which similar sets share one: by hash, those in ``often`` (sorted) behind the others by count."""
    n = len(shingles)
    k = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    if len(often):
        at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
        weight = np.where(often[at] == shingles, counts[at], 0)
        if weight.any():
            return shingles[np.lexsort((shingles, weight))[:k]]
    return shingles[:k]


def parity(shingles: np.ndarray, bits: int = BITS) -> bytes:
    """A bitmap of the hashes' last bits; a bit is set where an odd number of them fall."""
    return np.packbits(np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def wide(shingles: np.ndarray) -> bytes:
    """A parity bitmap of at least as many bits as shingles, a power of two; empty where ``BITS`` are as many."""
    return parity(shingles, 1 << (len(shingles) - 1).bit_length()) if len(shingles) > BITS else b""


def differing(one: bytes, two: bytes) -> int:
    """Differing bits of two wide bitmaps; the wider one is folded, as a parity of fewer last bits."""
    x, y = sorted((np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) if len(x) else x
    return int(np.bitwise_count(x ^ y).sum())


def _possible(size1: np.ndarray, size2: np.ndarray, bits1: np.ndarray, bits2: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can be similar; never false for sets that are."""
    other = np.bitwise_count(bits1 ^ bits2).sum(axis=1)
    return (np.minimum(size1, size2) >= similarity * np.maximum(size1, size2) - 1e-9) & (other * (1 + similarity) <= (size1 + size2) * (1 - similarity) + 1e-9)


def _bitmaps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def often_shared(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of a sample of documents have, sorted, and their counts. They decide the order only, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in shingle_sets(texts_of(b.column(0)), words):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    total = docs.count()
    sample = docs.where(F.col("row") < int(2**64 * min(1.0, SAMPLED / max(1, total)) - 2**63)) if total > SAMPLED else docs
    found = sample.select("text").mapInArrow(released(run), "s long").groupBy("s").count().where(f"count >= {OFTEN}")
    rows = found.orderBy(F.desc("count"), "s").limit(100_000).toArrow()
    s, n = rows["s"].to_numpy().view(np.uint64), rows["count"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def nodes_of(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, row, node, size, bits, wide, prefix) of every row."""
    often, counts = often_shared(docs, words)
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("bits", pa.binary()), ("wide", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"node": [], "size": [], "bits": [], "wide": [], "prefix": []}
            for s in shingle_sets(texts_of(b.column(2)), words):
                out["node"].append(int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True))
                out["size"].append(len(s))
                out["bits"].append(parity(s))
                out["wide"].append(wide(s))
                out["prefix"].append(prefix(s, similarity, often, counts).view(np.int64))
            yield to_batch(out | {"doc_id": b.column(0), "row": b.column(1)}, schema)

    return docs.mapInArrow(released(run), "doc_id long, row long, node long, size long, bits binary, wide binary, prefix array<long>")


def similar_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those pairs (u, v) whose whole sets are similar; before sets are compared, wide bitmaps cut the pairs of long texts."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True)
            kept = pa.array([differing(x.as_py(), y.as_py()) * (1 + similarity) <= (m + n) * (1 - similarity) + 1e-9 for m, n, x, y in rest], pa.bool_())
            yield to_batch({"u": b.column(0).filter(kept), "v": b.column(1).filter(kept)}, _PAIRS)

    one = nodes.select(F.col("node").alias("u"), F.col("size").alias("n1"), F.col("wide").alias("w1"))
    two = nodes.select(F.col("node").alias("v"), F.col("size").alias("n2"), F.col("wide").alias("w2"))
    pairs = pairs.join(one, "u").join(two, "v").select("u", "v", "n1", "n2", "w1", "w2")
    pairs = materialize(pairs.mapInArrow(released(close), "u long, v long"), "close")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "row"), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])
        for b in batches:
            yield to_batch({"node": b.column(0), "set": [s.tobytes() for s in shingle_sets(texts_of(b.column(1)), words)]}, schema)

    found = materialize(docs.join(wanted, "row").select("node", "text").mapInArrow(released(sets), "node long, set binary"), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for one, two in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * (1 + similarity) >= similarity * (len(x) + len(y)) - 1e-9)
            kept = pa.array(keep, pa.bool_())
            yield to_batch({"u": b.column(0).filter(kept), "v": b.column(1).filter(kept)}, _PAIRS)

    both = pairs.join(found.select(F.col("node").alias("u"), F.col("set").alias("su")), "u").join(found.select(F.col("node").alias("v"), F.col("set").alias("sv")), "v")
    return both.select("u", "v", "su", "sv").mapInArrow(released(check), "u long, v long").distinct()


def with_least(shared: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of each group's least node and another that can be similar; ``shared``: (node, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = pa.array(_possible(b.column(2).to_numpy(), b.column(3).to_numpy(), _bitmaps(b.column(4)), _bitmaps(b.column(5)), similarity))
                yield to_batch({"u": b.column(0).filter(ok), "v": b.column(1).filter(ok)}, _PAIRS)

    pairs = shared.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct()
    one = nodes.select(F.col("node").alias("u"), F.col("size").alias("n1"), F.col("bits").alias("b1"))
    two = nodes.select(F.col("node").alias("v"), F.col("size").alias("n2"), F.col("bits").alias("b2"))
    near = pairs.join(one, "u").join(two, "v").where(F.least("n1", "n2") >= similarity * F.greatest("n1", "n2") - 1e-9)
    return near.select("u", "v", "n1", "n2", "b1", "b2").mapInArrow(released(run), "u long, v long")


def _across(key: np.ndarray, node: np.ndarray, size: np.ndarray, part: np.ndarray, least: np.ndarray, bits: np.ndarray, similarity: float, small: int = 32) -> np.ndarray:
    """Pairs of each group of equal keys that can be similar, lie in different parts and are without the group's least node."""
    cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
    sizes = np.diff(cuts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    few, rest = (sizes <= small)[group], node != least
    found = [np.zeros((0, 2), np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        ok = rest[i] & rest[j] & (part[i] != part[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
        i, j = i[ok], j[ok]
        ok = _possible(size[i], size[j], bits[i], bits[j], similarity)
        found.append(np.stack([np.minimum(node[i], node[j])[ok], np.maximum(node[i], node[j])[ok]], axis=1))

    for lag in range(1, min(small, len(key))):
        at = np.flatnonzero((group[lag:] == group[:-lag]) & few[lag:])
        if not len(at):
            break
        add(at, at + lag)
    for low, high in zip(cuts[:-1][sizes > small], cuts[1:][sizes > small], strict=True):
        for i in range(low, high - 1):
            j = np.arange(i + 1, high)
            add(np.full(len(j), i), j)
    return np.unique(np.concatenate(found), axis=0)


def in_parts(shared: DataFrame, component: DataFrame) -> DataFrame:
    """(token, node, least, part) of the groups of over two nodes, each node with its component."""
    placed = shared.where("n > 2").join(component, "node", "left").withColumn("part", F.coalesce("component", "node"))
    return materialize(placed.select("token", "node", "least", "part"), "placed")


def with_pivots(placed: DataFrame, nodes: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs (u, v) of one node of each large mixed group, drawn by a hash of this ``turn``, and those of its other components."""
    drawn = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "part"))
    mixed = placed.groupBy("token").agg(F.count("*").alias("n"), F.min("part").alias("p1"), F.max("part").alias("p2"), drawn.alias("d")).where(f"p1 <> p2 and n > {CROWD}")
    # the flipped key keeps both sides' exchanges plain, so that a skewed group can be split
    mixed = mixed.select(F.bitwise_not("token").alias("flipped"), F.col("d.node").alias("pivot"), F.col("d.part").alias("own"))
    others = placed.withColumn("flipped", F.bitwise_not("token")).join(mixed, "flipped").where("part <> own")
    return with_least(others.select("node", F.col("pivot").alias("least")), nodes, similarity)


def across_components(placed: DataFrame, nodes: DataFrame, similarity: float, tile: int = 2048) -> DataFrame:
    """Pairs (u, v) within groups that can be similar, in different components, without the pairs of ``with_least``.

    Groups of over ``tile`` nodes are cut into tiles, of which every two are compared in a task of their own.
    """
    mixed = placed.groupBy("token").agg(F.count("*").alias("n"), F.min("part").alias("p1"), F.max("part").alias("p2")).where("p1 <> p2")
    # the flipped key keeps both sides' exchanges plain, so that a skewed group can be split
    mixed = mixed.select(F.bitwise_not("token").alias("flipped"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    member = placed.withColumn("flipped", F.bitwise_not("token")).join(mixed, "flipped").join(nodes.select("node", "size", "bits"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    member = member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    member = member.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "size", "part", "least", "bits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["token", "a", "b"], 20_000):
            key = np.stack([t[c].to_numpy() for c in ("token", "a", "b")], 1)
            found = _across(key, *[t[c].to_numpy() for c in ("node", "size", "part", "least")], _bitmaps(t["bits"]), similarity)
            if len(found):
                yield to_batch({"u": found[:, 0], "v": found[:, 1]}, _PAIRS)

    dealt = member.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b")
    return dealt.mapInArrow(released(compare), "u long, v long").distinct()


def similar_documents(documents: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id that links of similar sets reach, of every document."""
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    rows = materialize(nodes_of(docs, words, similarity), "shingles")
    firsts = [F.first(c).alias(c) for c in ("size", "bits", "wide", "prefix")]
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("owner"), F.min("row").alias("row"), *firsts), "nodes")
    tokens = nodes.select(F.explode("prefix").alias("token"), "node")
    held = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    held = held.select(F.bitwise_not("token").alias("flipped"), "n", "least")
    shared = tokens.withColumn("flipped", F.bitwise_not("token")).join(held, "flipped").select("token", "node", "n", "least")
    shared = materialize(shared, "shared")
    nodes = nodes.select("node", "owner", "row", "size", "bits", "wide")

    near = materialize(with_least(shared, nodes, similarity), "near")
    links = materialize(similar_pairs(near, nodes, docs, words, similarity), "links")
    placed = in_parts(shared, components(links))
    for turn in range(PIVOTS):
        near = materialize(with_pivots(placed, nodes, similarity, turn), "near")
        if near.isEmpty():
            break
        links = materialize(links.unionByName(similar_pairs(near, nodes, docs, words, similarity)), "links")
        placed = in_parts(shared, components(links))
    near = materialize(across_components(placed, nodes, similarity), "near")
    more = similar_pairs(near, nodes, docs, words, similarity)
    found = components(materialize(links.unionByName(more), "links"))
    named = materialize(nodes.select("node", "owner").join(found, "node", "left").select("node", "owner", F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("owner").alias("component_id"))
    least = least.select(F.bitwise_not("component").alias("flipped"), "component_id")
    classes = named.withColumn("flipped", F.bitwise_not("component")).join(least, "flipped").select("node", "component_id")
    return rows.select("doc_id", "node").join(materialize(classes, "classes"), "node").select("doc_id", "component_id")
