"""Substring dedup by prefix-partitioned suffix trees over words.

A document's suffix matters only if its first ``window`` words also start elsewhere, so the trees hold those suffixes alone: every
window of words selects its least-hashed gram of ``gram`` words (equal windows select equal grams, at the same place in the
window), and the windows of one gram form a chunk. The gram is the prefix that partitions the work; only grams in two documents or
more go on.

Leaves with equal texts are one leaf with its least document. That is settled first, for stretches of neighbouring chunks, whose
ends depend on the words alone, and then for the chunks of the distinct stretches. The distinct chunks of one gram are a group of
suffixes: a suffix array with its common prefix lengths is built, whose internal nodes at depth ``window`` or more are the
repeats; leaves below a node lose the node's words to the leaf of the least document.

A group larger than ``limit`` bytes gets longer prefixes: the windows of a chunk are halved by where in them the gram stands, so
that each half has more words in common (8, then 29, 40, 45, 48, 49), which are its new prefix; again until every group fits, or a
prefix is a whole window, where equal leaves are all there is. No group is dropped, sampled or held by one task beyond ``limit``.

Null and empty texts have no words. Rows without a doc_id come back with nothing removed, and remove nothing elsewhere.
Windows of rows with one doc_id never remove each other. Repeated rows each get the same result. Extra columns are
ignored, whatever their names. An empty table gives an empty result. Texts are read whole, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Words, join_counted, materialize, row_key, runs, slices, table, texts_of, to_batch

WINDOW, GRAM = 50, 8
#: Bytes of text in a group of suffixes.
LIMIT = 8 << 20
#: Bits of a gram's hash that are zero where a stretch of chunks ends: one in four.
STRETCH = 3
#: Keys that are sent to every task because their groups are the largest: at most so many, by the threshold.
LARGEST = 100_000
_LOW = np.uint64((1 << 28) - 1)


class Chunks:
    """Runs of windows that select one gram: first and last window and the gram (as word numbers), document and the gram's hash."""

    def __init__(self, words: Words, hashes: np.ndarray, window: int, gram: int, grams: Rolling):
        n, width = len(words), window - gram + 1
        if n < window:
            self.first = self.last = self.doc = self.gram = self.key = np.zeros(0, np.int64)
            return
        at = np.arange(n - gram + 1)
        g = grams.of(hashes, at, at + gram)
        least = (g & ~_LOW) | (at.astype(np.uint64) & _LOW)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if width > size:
            least = np.minimum(least[: size - width], least[width - size :])
        i = np.arange(len(least))
        chosen = i + ((least - i.astype(np.uint64)) & _LOW).astype(np.int64)
        whole = np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])
        if not len(whole):
            self.first = self.last = self.doc = self.gram = self.key = np.zeros(0, np.int64)
            return
        c, d = chosen[whole], words.doc[whole]
        cut = np.flatnonzero((np.diff(c) != 0) | (np.diff(d) != 0) | (np.diff(whole) != 1)) + 1
        begin, end = np.r_[0, cut], np.r_[cut, len(whole)] - 1
        self.first, self.last, self.doc = whole[begin], whole[end], d[begin]
        self.gram = c[begin]
        self.key = g[self.gram].view(np.int64)


class _Reader:
    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.bytes, self.grams, self.common = Rolling(11), Rolling(12), Rolling(13)

    def chunks(self, texts: list[bytes]) -> tuple[Words, np.ndarray, Chunks]:
        w = Words(texts)
        h = self.bytes.of(w.array, w.start, w.end)
        return w, h, Chunks(w, h, self.window, self.gram, self.grams)


def _anchor_table(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, row, key): the grams that a document's windows select, each once."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(window, gram)
        for b in batches:
            texts = texts_of(b.column(2))
            for low, high in slices(texts):
                _, _, c = reader.chunks(texts[low:high])
                if len(c.key):
                    order = np.lexsort((c.key, c.doc))
                    key, doc = c.key[order], c.doc[order]
                    new = np.r_[True, (np.diff(key) != 0) | (np.diff(doc) != 0)]
                    take = pa.array(doc[new] + low)
                    yield to_batch({"doc_id": b.column(0).take(take), "row": b.column(1).take(take), "key": key[new]}, schema)

    return docs.mapInArrow(run, "doc_id long, row long, key long")


_ROW = "p1 long, p2 long, at int, windows int, least long, key long, gram int, content binary"
_ROWS = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("at", pa.int32()), ("windows", pa.int32()), ("least", pa.int64()), ("key", pa.int64()), ("gram", pa.int32()), ("content", pa.binary())])


def _stretch_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Stretches of a document's chunks whose grams are among its ``keys``; p1 and least: its doc_id, p2: its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(window, gram)
        for b in batches:
            texts, keys = texts_of(b.column(2)), b.column(3)
            for low, high in slices(texts):
                w, _, c = reader.chunks(texts[low:high])
                firsts, lasts, owners = [], [], []
                cuts = np.searchsorted(c.doc, np.arange(high - low + 1))
                for d in range(high - low):
                    i, j = cuts[d], cuts[d + 1]
                    if i < j and keys[low + d].is_valid:
                        take = i + np.flatnonzero(np.isin(c.key[i:j], keys[low + d].values.to_numpy()))
                        first, last = _stretches(c.first[take], c.last[take], c.key[take])
                        firsts.append(first)
                        lasts.append(last)
                        owners.append(np.full(len(first), d))
                if firsts:
                    first, last, own = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(owners)
                    ids = b.column(0).take(pa.array(own + low))
                    content = [w.text[x:y] for x, y in zip(w.start[first].tolist(), w.end[last + window - 1].tolist(), strict=True)]
                    zero = np.zeros(len(own), np.int64)
                    yield to_batch({"p1": ids, "p2": b.column(1).take(pa.array(own + low)), "at": first - w.first[own], "windows": last - first + 1, "least": ids, "key": zero, "gram": zero, "content": content}, _ROWS)

    return docs.mapInArrow(run, _ROW)


def _stretches(first: np.ndarray, last: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring chunks of one document joined up to a chunk whose gram's hash ends in zero bits.

    The ends depend on the words alone, so near copies share most stretches; each is one row where it was four.
    """
    if not len(key):
        return first, last
    joined = (first[1:] == last[:-1] + 1) & ((key[1:] & STRETCH) != 0)
    begin = np.flatnonzero(np.r_[True, ~joined])
    return first[begin], last[np.r_[begin[1:], len(key)] - 1]


def _chunk_rows(stretches: DataFrame, window: int, gram: int) -> DataFrame:
    """The chunks of distinct stretches (id1, id2, least, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(window, gram)
        for b in batches:
            content = b.column(3).to_pylist()
            for low, high in slices(content):
                w, _, c = reader.chunks(content[low:high])
                own = pa.array(c.doc + low)
                body = [w.text[x:y] for x, y in zip(w.start[c.first].tolist(), w.end[c.last + window - 1].tolist(), strict=True)]
                yield to_batch({"p1": b.column(0).take(own), "p2": b.column(1).take(own), "at": c.first - w.first[c.doc], "windows": c.last - c.first + 1, "least": b.column(2).take(own), "key": c.key, "gram": c.gram - c.first, "content": body}, _ROWS)

    return stretches.select("id1", "id2", "least", "content").mapInArrow(run, _ROW)


def parts_of(width: int, level: int) -> np.ndarray:
    """Where the parts of a gram's ``width`` places in a window begin at a level of halving."""
    return np.asarray([width * k // 2**level for k in range(2**level + 1)])


def _halved_rows(contents: DataFrame, window: int, gram: int, level: int) -> DataFrame:
    """Chunks (id1, id2, least, content, gram) cut into the windows of each part of a level, under the words that these share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, bounds = _Reader(window, 1), parts_of(window - gram + 1, level)
        for b in batches:
            content = b.column(3).to_pylist()
            for low, high in slices(content):
                w = Words(content[low:high])
                h = reader.bytes.of(w.array, w.start, w.end)
                counts = np.diff(w.first) - window + 1
                doc = np.repeat(np.arange(high - low), counts)
                i = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                g = b.column(4).to_numpy()[low:high][doc]
                part = np.searchsorted(bounds, g - i, "right") - 1
                first = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(doc) != 0)]) if len(doc) else np.zeros(0, np.int64)
                size = np.diff(np.r_[first, len(doc)])
                doc, i, g, part = doc[first], i[first], g[first], part[first]
                gram_at = w.first[doc] + g
                key = reader.common.of(h, gram_at - bounds[part], gram_at - bounds[part + 1] + 1 + window).view(np.int64) + part
                begin = w.first[doc] + i
                body = [w.text[x:y] for x, y in zip(w.start[begin].tolist(), w.end[begin + size + window - 2].tolist(), strict=True)]
                own = pa.array(doc + low)
                yield to_batch({"p1": b.column(0).take(own), "p2": b.column(1).take(own), "at": i, "windows": size, "least": b.column(2).take(own), "key": key, "gram": g - i, "content": body}, _ROWS)

    return contents.select("id1", "id2", "least", "content", "gram").mapInArrow(run, _ROW)


class Tree:
    """A suffix tree of some texts' words, as a suffix array with common prefix lengths.

    ``leaves``: the words at which windows begin, in the order of the suffixes there; ``lcp``: how many words each shares with the
    leaf before it. A stretch of lcp of d or more, with the leaf before it, is the leaves below an internal node of depth d or more.
    """

    def __init__(self, words: Words, hashes: np.ndarray, window: int):
        n, texts = len(words), len(words.first) - 1
        # a separator of its own stands behind each text, so no suffix goes on into the next
        place = np.arange(n) + words.doc
        rank = np.empty(n + texts, np.int64)
        kinds = np.unique(hashes, return_inverse=True)[1]
        rank[place] = kinds
        rank[words.first[1:] + np.arange(texts)] = n + np.arange(texts)
        levels, size = [rank], 1
        # the order by twice as many words is that of pairs: by these words here, then by those behind them
        while size <= (np.diff(words.first).max() if texts else 0):
            behind = np.full(len(rank), -1, np.int64)
            behind[:-size] = rank[size:]
            rank = np.unique(rank * (n + texts + 1) + behind + 1, return_inverse=True)[1].astype(np.int64)
            levels.append(rank)
            size *= 2
        starts = np.flatnonzero(words.doc[: max(0, n - window + 1)] == words.doc[window - 1 :]) if n >= window else np.zeros(0, np.int64)
        self.leaves = starts[np.argsort(rank[place[starts]], kind="stable")]
        i, j = place[self.leaves[:-1]], place[self.leaves[1:]]
        self.lcp = np.zeros(max(0, len(starts) - 1), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = (levels[k][i] == levels[k][j]) << k
            self.lcp += same
            i, j = i + same, j + same

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First leaf, end of leaves and depth of the topmost internal nodes of at least ``depth`` words."""
        begin, end = runs(self.lcp >= depth)
        least = np.minimum.reduceat(np.r_[self.lcp, 0], np.stack([begin, end], axis=1).ravel())[::2] if len(begin) else begin
        return begin, end + 1, least


_FOUND = "id1 long, id2 long, least long, content binary, gram int, lost array<struct<a int, b int>>"
_RUN = pa.struct([("a", pa.int32()), ("b", pa.int32())])
_FOUNDS = pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("least", pa.int64()), ("content", pa.binary()), ("gram", pa.int32()), ("lost", pa.list_(_RUN))])


def lost_windows(contents: list[bytes], least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (text, first, last) of windows that a text of a smaller ``least`` has too."""
    w = Words(contents)
    tree = Tree(w, Rolling(11).of(w.array, w.start, w.end), window)
    gone = np.zeros(len(w), bool)
    begin, end, _ = tree.nodes(window)
    if len(begin):
        leaf = np.concatenate([tree.leaves[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
        own = least[w.doc[leaf]]
        size = end - begin
        gone[leaf] = np.repeat(np.minimum.reduceat(own, np.cumsum(size) - size), size) < own
    first, last = runs(gone)  # a text's last window - 1 words begin none, so runs end with their text
    doc = w.doc[first] if len(first) else first
    return doc, first - w.first[doc], last - 1 - w.first[doc]


def sized(batches: Iterator[pa.RecordBatch], limit: int, lot: int = 1 << 20) -> Iterator[tuple[pa.Table, bool]]:
    """Whole groups of rows sorted by key, several at a time; parts of a group of over ``limit`` bytes come marked, unheld."""
    held: list[pa.RecordBatch] = []
    size, over = 0, None
    for batch in batches:
        if over is not None and batch.num_rows:
            same = int(np.searchsorted(batch["key"].to_numpy() != over, True))
            if same:
                yield pa.Table.from_batches([batch.slice(0, same)]), True
            batch = batch.slice(same)
            over = None if batch.num_rows else over
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < min(lot, limit):
            continue
        merged = pa.Table.from_batches(held).combine_chunks()
        key = merged["key"].to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cut:
            yield merged.slice(0, cut), False
        rest = merged.slice(cut)
        if (size := rest.nbytes) > limit:
            yield rest, True
            held, size, over = [], 0, key[-1]
        else:
            held = rest.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), False


def _ranges(key: np.ndarray, content: list[bytes], lot: int = 1 << 20) -> Iterator[tuple[int, int, int]]:
    """Ranges of whole groups of about ``lot`` bytes, and the bytes of the range's largest group."""
    cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    bytes_ = np.add.reduceat(np.fromiter(map(len, content), np.int64, len(content)), cuts[:-1])
    low = size = most = 0
    for j, n in zip(cuts[1:].tolist(), bytes_.tolist(), strict=True):
        size, most = size + n, max(most, n)
        if size >= lot:
            yield low, j, most
            low, size, most = j, 0, 0
    if low < len(key):
        yield low, len(key), most


def _tree_runs(distinct: DataFrame, window: int, limit: int) -> DataFrame:
    """Of each content what its group's tree takes from it; contents of too large a group come back as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, over in sized(batches, limit):
            if over:
                nothing = pa.nulls(t.num_rows, _FOUNDS.field("lost").type)
                yield to_batch({k: t[k].combine_chunks() for k in ("id1", "id2", "least", "content", "gram")} | {"lost": nothing}, _FOUNDS)
                continue
            content, least, key = t["content"].to_pylist(), t["least"].to_numpy(), t["key"].to_numpy()
            for low, high, _ in _ranges(key, content):
                if (key[low + 1 : high] == key[low : high - 1]).any():
                    doc, first, last = lost_windows(content[low:high], least[low:high], window)
                    new = np.flatnonzero(np.r_[True, np.diff(doc) != 0]) if len(doc) else doc
                    if len(new):
                        own = pa.array(doc[new] + low)
                        lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(doc)], pa.int32()), pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], fields=list(_RUN)))
                        column = lambda k: t[k].combine_chunks().take(own)  # noqa: B023, E731
                        yield to_batch({"id1": column("id1"), "id2": column("id2"), "least": column("least"), "content": pa.nulls(len(own), pa.binary()), "gram": column("gram"), "lost": lists}, _FOUNDS)

    dealt = distinct.select("id1", "id2", "least", "content", "gram", "key").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, _FOUND)


def _settle(rows: DataFrame, window: int, gram: int, level: int, limit: int) -> DataFrame:
    """(p1, p2, lost): the runs of windows that each parent loses, from rows of one level.

    Levels: -1 stretches, 0 chunks, then chunks halved once, twice ... A row whose content has a smaller document elsewhere loses
    all its windows; of a content's least document, the trees, or the next level, tell which.
    """
    ids = (F.xxhash64("content").alias("id1"), F.xxhash64(F.lit(7), "content").alias("id2"))
    rows = materialize(rows.select("*", *ids), f"level{level}")
    facts = rows.groupBy("id1", "id2").agg(F.min("least").alias("first"), F.max("least").alias("most"), F.count("*").alias("n"))
    width = window - gram + 1
    lost = None
    if level < 0 or 2**level < width:
        distinct = rows.groupBy("id1", "id2", "content", "gram", "key").agg(F.min("least").alias("least"))
        if level < 0:
            lost = _settle(_chunk_rows(distinct, window, gram), window, gram, 0, limit)
        else:
            sizes = rows.groupBy("key").agg(F.sum(F.octet_length("content")).alias("bytes"))
            total = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
            # the largest groups' keys are known to every task, so that none of them is gathered
            large = F.broadcast(sizes.where(F.col("bytes") > max(limit, total / LARGEST)).select("key"))
            found = materialize(_tree_runs(distinct.join(large, "key", "left_anti"), window, limit), "trees")
            over = distinct.join(large, "key", "left_semi").select("id1", "id2", "least", "content", "gram").unionByName(found.where("lost is null").drop("lost"))
            lost = found.where("lost is not null").select(F.col("id1").alias("p1"), F.col("id2").alias("p2"), "lost")
            over = materialize(over, "over")
            if not over.isEmpty():
                lost = lost.unionByName(_settle(_halved_rows(over, window, gram, level + 1), window, gram, level + 1, limit))
    if lost is not None:
        facts = facts.join(lost.select(F.col("p1").alias("id1"), F.col("p2").alias("id2"), "lost"), ["id1", "id2"], "left")
    else:
        facts = facts.withColumn("lost", F.lit(None).cast("array<struct<a int, b int>>"))
    facts = materialize(facts.where("most > first or lost is not null"), "facts")
    joined = join_counted(rows.select("p1", "p2", "at", "windows", "least", "id1", "id2"), facts, ["id1", "id2"], "n", rows.count())
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).alias("b")))
    gone = F.transform(F.when(F.col("first") < F.col("least"), whole).otherwise(F.col("lost")), lambda r: F.struct((F.col("at") + r["a"]).cast("int").alias("a"), (F.col("at") + r["b"]).cast("int").alias("b")))
    taken = joined.where("first < least or lost is not null").select("p1", "p2", gone.alias("gone"))
    return taken.groupBy("p1", "p2").agg(F.flatten(F.collect_list("gone")).alias("lost"))


def repeated_windows(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """(doc_id, row, lost array<struct<a, b>>): runs of windows that also start in a document with a smaller doc_id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id is not null").select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    anchors = materialize(_anchor_table(docs, window, gram), "anchors")
    known = anchors.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b")
    candidates = join_counted(anchors, materialize(known.select("key", "n"), "known"), ["key"], "n", anchors.count())
    keys = candidates.groupBy("doc_id", "row").agg(F.collect_list("key").alias("keys"))
    source = docs.join(keys, ["doc_id", "row"]).select("doc_id", "row", "text", "keys")
    found = _settle(_stretch_rows(source, window, gram), window, gram, -1, limit)
    return found.select(F.col("p1").alias("doc_id"), F.col("p2").alias("row"), "lost")


def dedup_substrings(documents: DataFrame, window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document's words that no earlier document repeats, joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
    lost = repeated_windows(documents, window, limit=limit)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row", row_key("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for low, high in slices(texts):
                w = Words(texts[low:high])
                gone = np.zeros(len(w) + 1, np.int64)
                for d in range(high - low):
                    own = b.column(2)[low + d]
                    if own.is_valid:
                        np.add.at(gone, w.first[d] + own.values.field("a").to_numpy(), 1)
                        np.add.at(gone, w.first[d] + own.values.field("b").to_numpy() + window, -1)
                keep = np.cumsum(gone)[:-1] == 0
                body = w.array[np.repeat(keep, w.end - w.start + 1)].tobytes() if len(w) else b""
                size = np.where(keep, w.end - w.start + 1, 0)
                ends = np.concatenate(([0], np.cumsum(size)))[w.first]
                kept = [body[i : max(i, j - 1)] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                counts = np.diff(w.first)
                left = np.diff(np.concatenate(([0], np.cumsum(keep)))[w.first])
                yield to_batch({"doc_id": b.column(0).slice(low, high - low), "n_words": counts, "n_removed": counts - left, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "kept": pa.array(kept, pa.binary()).cast(pa.string())}, schema)

    source = docs.join(lost, ["doc_id", "row"], "left").select("doc_id", "text", "lost")
    return source.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


#: DuckDB: each document's windows by their words, the least document of each, and the words that no later window covers.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), t AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 49], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), m AS (SELECT s, min(doc_id) AS first FROM t GROUP BY s)
, gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM t JOIN m USING (s) WHERE first < doc_id
), g AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
