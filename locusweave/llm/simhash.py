"""SimHash near-duplicates: pigeonhole blocks of fingerprints, verified Hamming distances, components.

Null and empty texts (and texts of white space) have the fingerprint zero; texts of fewer words than a shingle are one
shingle. Every row gives a row: repeated rows the same one each time, rows without a doc_id their fingerprint and no component;
these link nothing. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, components, groups, materialize, mix, released, row_key, slices, table, texts_of, to_batch
from .jaccard import similar_documents

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANE = (np.arange(8) * 256)[None, :]
#: Fixed odd constants that derive further 64-bit hashes from one.
_MORE = np.random.default_rng(20_26).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _majority(hashes: np.ndarray) -> bytes:
    """Bits that are set in over half the hashes, most significant first."""
    lanes = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((lanes + _LANE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return np.packbits(counts.ravel() * 2 > len(hashes)).tobytes()


def fingerprints_of(texts: list[bytes], words: int, lanes: int = 1, distinct: bool = False) -> list[bytes]:
    """SimHash fingerprints of 64 * lanes bits over shingles of ``words`` lower-cased words, with or without repeats."""
    out = []
    digest = xxhash.xxh64_digest
    for low, high in slices(texts):
        w = Words(texts[low:high], lower=True)
        start, end, text = w.start.tolist(), w.end.tolist(), w.text
        first = w.first.tolist()
        for d in range(high - low):
            a, b = first[d], first[d + 1]
            if a == b:
                out.append(bytes(8 * lanes))
                continue
            n = max(1, b - a - words + 1)
            last = min(words, b - a) - 1
            joined = b"".join([digest(text[i:j], 42) for i, j in zip(start[a : a + n], end[a + last : a + last + n])])
            h = np.frombuffer(joined, ">u8").astype(np.uint64)
            if distinct:
                h = np.unique(h)
            out.append(b"".join(_majority(h if k == 0 else mix(h * _MORE[k])) for k in range(lanes)))
    return out


def fingerprint_table(documents: DataFrame, words: int, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, row, fp binary) of every row; ``row`` is its key."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield to_batch({"doc_id": b.column(0), "row": b.column(1), "fp": fingerprints_of(texts_of(b.column(2)), words, lanes, distinct)}, schema)

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(released(run), "doc_id long, row long, fp binary")


def block_masks(bits: int, blocks: int, equal: int) -> list[bytes]:
    """Masks of every choice of ``equal`` out of ``blocks`` blocks of a fingerprint's bits.

    Fingerprints that differ in at most ``blocks - equal`` bits are equal under one of the masks at least.
    """
    edges = np.linspace(0, bits, blocks + 1).round().astype(int)
    masks = []
    for chosen in combinations(range(blocks), equal):
        flags = np.zeros(bits, np.uint8)
        for c in chosen:
            flags[edges[c] : edges[c + 1]] = 1
        masks.append(np.packbits(flags).tobytes())
    return masks


def _stars(nodes: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A star for every component of the fingerprints of one tile: (node, smallest node)."""
    open_ = np.arange(len(nodes))
    edges = []
    while len(open_):
        members, frontier, open_ = [open_[0]], [open_[0]], open_[1:]
        while frontier and len(open_):
            near = np.bitwise_count(prints[open_] ^ prints[frontier.pop()]).sum(axis=1) <= radius
            if near.any():
                found = open_[near].tolist()
                members += found
                frontier += found
                open_ = open_[~near]
        if len(members) > 1:
            ids = nodes[members]
            root = int(ids.min())
            edges += [(int(i), root) for i in ids if i != root]
    return edges


def _links_in(key: np.ndarray, node: np.ndarray, prints: np.ndarray, radius: int, small: int = 16) -> np.ndarray:
    """Links within each group of equal keys: pairs in groups of at most ``small`` members, stars in larger ones."""
    cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
    sizes = np.diff(cuts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    few = (sizes <= small)[group]
    found = [np.array([e for i, j in zip(cuts[:-1][sizes > small], cuts[1:][sizes > small], strict=True) for e in _stars(node[i:j], prints[i:j], radius)], np.int64).reshape(-1, 2)]
    for lag in range(1, min(small, len(key))):
        at = np.flatnonzero((group[lag:] == group[:-lag]) & few[lag:])
        if not len(at):
            break
        at = at[np.bitwise_count(prints[at] ^ prints[at + lag]).sum(axis=1) <= radius]
        found.append(np.stack([np.maximum(node[at], node[at + lag]), np.minimum(node[at], node[at + lag])], axis=1))
    return np.concatenate(found)


def near_links(distinct: DataFrame, bits: int, radius: int, blocks: int, equal: int, tile: int = 2048) -> DataFrame:
    """Links (u, v) that join whatever is within ``radius`` bits, from (node, fp), fp distinct.

    Each fingerprint goes to one bucket for each mask. Buckets of over ``tile`` members are cut into tiles, of which every
    pair is compared in a task of its own, so no task holds more than two tiles; a task returns a spanning star for each
    component that it sees, never all pairs.
    """
    lanes = bits // 64
    masks = [np.frombuffer(m, np.uint8) for m in block_masks(bits, blocks, equal)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("fp", pa.binary())])
        for b in batches:
            if not b.num_rows:
                continue
            prints = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for k, m in enumerate(masks):
                part = (prints & m).view(">u8").astype(np.uint64)
                key = np.full(b.num_rows, k + 1, np.uint64)
                for lane in range(lanes):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ part[:, lane])
                yield to_batch({"bucket": key.view(np.int64), "node": b.column(0), "fp": b.column(1)}, schema)

    keyed = distinct.select("node", "fp").mapInArrow(spread, "bucket long, node long, fp binary")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # the flipped key keeps both sides' exchanges plain, so that a skewed bucket can be split
    sizes = sizes.select(F.bitwise_not("bucket").alias("flipped"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    member = keyed.withColumn("flipped", F.bitwise_not("bucket")).join(sizes, "flipped")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    member = member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    member = member.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for t in groups(batches, ["bucket", "a", "b"], 20_000):
            key = np.stack([t[c].to_numpy() for c in ("bucket", "a", "b")], 1)
            node = t["node"].to_numpy()
            prints = np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint64).reshape(t.num_rows, -1)
            edges = _links_in(key, node, prints, radius)
            if len(edges):
                yield to_batch({"u": edges[:, 0], "v": edges[:, 1]}, schema)

    dealt = member.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return dealt.mapInArrow(compare, "u long, v long").distinct()


def node_of(lanes: int) -> Column:
    """A fingerprint's number among the links: its own 64 bits; a hash of wider ones."""
    return F.conv(F.hex("fp"), 16, -10).cast("long") if lanes == 1 else F.xxhash64("fp")


def near_duplicates(documents: DataFrame, words: int = 3, radius: int = 3, lanes: int = 1, blocks: int = 5, equal: int = 2, sets: bool = False) -> DataFrame:
    """(doc_id, row, fp, component_id) of every row; fingerprints within ``radius`` bits are linked.

    Copies share a fingerprint and count as one node, so a group of copies costs one row for each task.
    """
    prints = materialize(fingerprint_table(documents, words, lanes, sets), "fingerprints")
    distinct = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("owner")), "distinct")
    # a document id may carry several texts; a node is a fingerprint
    links = near_links(distinct.select(node_of(lanes).alias("node"), "fp"), 64 * lanes, radius, blocks, equal)
    found = components(links)
    named = distinct.withColumn("node", node_of(lanes)).join(found, "node", "left").select("fp", "owner", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("owner").alias("component_id"))
    least = least.select(F.bitwise_not("component").alias("flipped"), "component_id")
    classes = named.withColumn("flipped", F.bitwise_not("component")).join(least, "flipped").select("fp", "component_id")
    found = prints.join(materialize(classes, "classes"), "fp", "left")
    return found.select("doc_id", "row", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_linked(documents: DataFrame) -> DataFrame:
    """The rows, with all their columns, of one document (the smallest doc_id) of each group of linked fingerprints; rows without doc_id stay.

    A row goes by its own text: another text under its doc_id stays if nothing smaller links to it.
    """
    gone = near_duplicates(documents).where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    names = documents.columns
    whole = documents.select(F.struct(*[documents[f"`{c}`"] for c in names]).alias("__doc"))
    whole = whole.withColumns({"__id": F.col("__doc.doc_id").cast("long"), "__row": row_key("__doc.doc_id", "__doc.text")})
    return whole.join(gone, ["__id", "__row"], "left_anti").select(*[F.col("__doc")[c].alias(c) for c in names])


def drop_near_duplicates(documents: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Like ``drop_linked`` by similar sets of shingles instead of fingerprints (see ``jaccard``), and by doc_id; no registered query uses it."""
    names = documents.columns
    classes = similar_documents(documents, similarity)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    whole = documents.select(F.struct(*[documents[f"`{c}`"] for c in names]).alias("__doc"))
    kept = whole.join(gone, F.col("__doc.doc_id").cast("long") == F.col("__gone"), "left_anti")
    return kept.select(*[F.col("__doc")[c].alias(c) for c in names])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
