"""Ranked lexical search over blocks of documents, most of which their term maxima rule out.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. The items are dealt into lots
of bounded size. For a lot a forward index is written: blocks of at most DOCUMENTS consecutive documents, with every document's
(term, impact) pairs and for every term of the block its largest impact, where a term's impact is what it scores in a document at
weight one. Terms that no item of the lot holds score nothing and are not in it. Counting the pairs gives the terms' weights; weights
times largest impacts bound every block for every item. Each item's SEEDS best-bounded blocks of the whole index are scored first: the k-th
best score of their documents is where the item's threshold starts. Then every task sorts its blocks by an item's bound and
scores them from the top, in growing rounds; the threshold rises with the documents found, and the item is done at the first
bound below it. Blocks with bounds equal to the threshold are scored, so no tie is lost.

Null and empty documents, and those without terms, count nowhere. Documents without a doc_id count in the statistics and are never found.
Repeated documents are documents of their own, found as often as they stand there. Texts of any length are indexed whole. Equal scores
rank by doc_id. Items without an id take no part; null items and those without terms find nothing; equal items are one,
and items with one id and different texts have their ranks each. Extra columns are ignored; an empty table on either side gives
an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, table, texts_of, to_batch

K, DOCUMENTS, SEEDS, ROUND = 10, 4, 4, 16
#: Items and bytes of items that the driver and a task hold at a time, and bounds that a task computes at a time.
ITEMS, BYTES, CELLS = 2048, 1 << 21, 1 << 18

_BYTE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LISTS = {"docs": pa.int64(), "doc": pa.int32(), "term": pa.int32(), "impact": pa.int32(), "own": pa.int32(), "top": pa.int32()}
_BLOCK = pa.schema([("block", pa.int64()), *((c, pa.list_(kind)) for c, kind in _LISTS.items())])
_DDL = "block long, docs array<long>, doc array<int>, term array<int>, impact array<int>, own array<int>, top array<int>"
_NONE = "item_id long, rank int, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTE).split()


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have terms, and how many terms they have together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            sizes = [len(terms_of(t)) for t in texts_of(batch.column(0))]
            n, total = n + len(sizes) - sizes.count(0), total + sum(sizes)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})

    facts = docs.select("text").mapInArrow(count, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return facts["n"] or 0, facts["total"] or 0


class Lot:
    """Items that are searched together: which of them hold a term, how often, and at what weight."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.asarray([i for i, _ in items], np.int64)
        counts = [Counter(terms_of(t.encode())) for _, t in items]
        self.names: dict[bytes, int] = {}
        rows = [(self.names.setdefault(t, len(self.names)), q, c) for q, own in enumerate(counts) for t, c in own.items()]
        at = np.asarray(sorted(rows), np.int64).reshape(-1, 3)
        self.item, self.weight = at[:, 1], at[:, 2]
        self.first = np.searchsorted(at[:, 0], np.arange(len(self.names) + 1))

    def __len__(self) -> int:
        return len(self.ids)

    def weigh(self, held: np.ndarray, documents: int) -> None:
        weight = np.asarray([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)
        self.weight = self.weight * np.repeat(weight, np.diff(self.first))

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``term``, item, weight) of every item that holds each of the terms."""
        size = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(np.arange(len(term)), size), self.item[at], self.weight[at]


def blocks(docs: pa.Array, texts: list[bytes], lot: Lot, facts: tuple[int, int], documents: int, number: int) -> pa.RecordBatch:
    """Blocks of some documents, from ``number`` on; documents without a term of the lot are in none."""
    n_all, total = facts
    words = [terms_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    term = np.fromiter(map(lot.names.get, chain.from_iterable(words), repeat(-1)), np.int64, sizes.sum())
    hit = np.flatnonzero(term >= 0)
    key, tf = np.unique(np.repeat(np.arange(len(words)), sizes)[hit] * len(lot.names) + term[hit], return_counts=True)
    row, term = key // len(lot.names), key % len(lot.names)
    m = np.asarray([25 + 75 * n * n_all // total for n in sizes.tolist()], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
    used, doc = np.unique(row, return_inverse=True)
    block = doc // documents
    count = -(-len(used) // documents)
    bound, at = np.unique(block * len(lot.names) + term, return_inverse=True)
    top = np.zeros(len(bound), np.int64)
    np.maximum.at(top, at, impact)

    def lists(column: str, owner: np.ndarray, values) -> pa.Array:
        values = values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)), values.cast(_LISTS[column]))

    columns = {
        "block": number + np.arange(count),
        "docs": lists("docs", np.arange(len(used)) // documents, docs.take(pa.array(used))),
        "doc": lists("doc", block, doc % documents),
        "term": lists("term", block, term),
        "impact": lists("impact", block, impact),
        "own": lists("own", bound // len(lot.names), bound % len(lot.names)),
        "top": lists("top", bound // len(lot.names), top),
    }
    return to_batch(columns, _BLOCK)


def forward(docs: DataFrame, lot: Lot, facts: tuple[int, int], path: str, documents: int = DOCUMENTS) -> DataFrame:
    """The lot's forward index, written to ``path``. Blocks are made of what a task reads one after the other; no row is shuffled."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lot)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = texts_of(batch.column(1))
            for low, high in slices(texts):
                made = blocks(batch.column(0).slice(low, high - low), texts[low:high], sent.value, facts, documents, number)
                number += made.num_rows
                yield made

    docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(gather, _DDL).write.parquet(path)
    return spark.read.schema(_DDL).parquet(path)


class Part:
    """Some blocks of a batch, their lists laid end to end, each value with its block."""

    def __init__(self, batch: pa.RecordBatch, low: int, size: int):
        self.batch = batch.slice(low, size)
        self.size = self.batch.num_rows

    def of(self, column: str) -> pa.Array:
        return self.batch.column(column).flatten()

    def values(self, column: str) -> np.ndarray:
        return self.of(column).to_numpy(zero_copy_only=False).astype(np.int64)

    def owner(self, column: str) -> np.ndarray:
        return np.repeat(np.arange(self.size), np.diff(self.batch.column(column).offsets.to_numpy()))

    def bounds(self, lot: Lot) -> np.ndarray:
        """Bound of each block for each item."""
        out = np.zeros(self.size * len(lot), np.int64)
        at, item, weight = lot.expand(self.values("own"))
        np.add.at(out, self.owner("own")[at] * len(lot) + item, weight * self.values("top")[at])
        return out.reshape(self.size, len(lot))

    def scores(self, lot: Lot, active: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(score of each document for each item, documents), of the blocks that are active for the item."""
        block, docs = self.owner("term"), self.of("docs")
        begin = np.cumsum([0, *np.diff(self.batch.column("docs").offsets.to_numpy())])
        used = np.flatnonzero(active.any(axis=1)[block])
        block, doc, impact = block[used], self.values("doc")[used], self.values("impact")[used]
        at, item, weight = lot.expand(self.values("term")[used])
        kept = active[block[at], item]
        at = at[kept]
        out = np.zeros(len(docs) * len(lot), np.int64)
        np.add.at(out, (begin[block[at]] + doc[at]) * len(lot) + item[kept], weight[kept] * impact[at])
        return out.reshape(len(docs), len(lot)), docs


def parts(batches: Iterator[pa.RecordBatch], lot: Lot) -> Iterator[Part]:
    size = max(1, CELLS // len(lot))
    for batch in batches:
        for low in range(0, batch.num_rows, size):
            yield Part(batch, low, size)


class Best:
    """The k best documents of each item so far, and the score that others must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = np.maximum(floor, 1), k
        self.item = self.doc = self.score = np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, docs: pa.Array) -> None:
        named = np.asarray(docs.is_valid())
        row, item = np.nonzero((scores >= self.floor) & named[:, None])
        if not len(row):
            return
        item = np.concatenate((self.item, item))
        doc = np.concatenate((self.doc, docs.fill_null(0).to_numpy(zero_copy_only=False)[row]))
        score = np.concatenate((self.score, scores[row, item[len(self.item) :]]))
        order = np.lexsort((doc, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], np.arange(len(self.floor)))[item[order]]
        kept = order[place < self.k]
        self.item, self.doc, self.score = item[kept], doc[kept], score[kept]
        last = order[place == self.k - 1]
        self.floor[item[last]] = np.maximum(self.floor[item[last]], score[last])


def scan(index: DataFrame, lot: Lot, floor: np.ndarray, k: int) -> DataFrame:
    """(q, doc_id, score) of each task's k best documents for each item that reach its floor.

    ``index`` may have a column ``items``: the only items that a block is scored for.
    """
    sent = index.sparkSession.sparkContext.broadcast((lot, floor))
    schema = pa.schema([("q", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, floor = sent.value
        best = Best(floor, k)
        for part in parts(batches, lot):
            bound = part.bounds(lot)
            if "items" in part.batch.schema.names:
                only = np.zeros(bound.shape, bool)
                only[part.owner("items"), part.values("items")] = True
                bound = np.where(only, bound, 0)
            order = np.argsort(-bound, axis=0, kind="stable")
            low, width = 0, ROUND
            while low < part.size:
                next_ = order[low : low + width]
                reach = np.take_along_axis(bound, next_, 0) >= best.floor
                if not reach.any():
                    break
                active = np.zeros(bound.shape, bool)
                np.put_along_axis(active, next_, reach, 0)
                best.offer(*part.scores(lot, active))
                low, width = low + width, width * 4
        yield to_batch({"q": best.item, "doc_id": best.doc, "score": best.score}, schema)

    return index.mapInArrow(run, "q int, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def document_counts(index: DataFrame, lot: Lot) -> np.ndarray:
    """How many documents hold each of the lot's terms: one pair in the index for each."""
    n = len(lot.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n)
        at = np.flatnonzero(total)
        yield to_batch({"t": at, "n": total[at]}, pa.schema([("t", pa.int32()), ("n", pa.int64())]))

    out = np.zeros(n, np.int64)
    for r in index.select("term").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[r["t"]] = r["n"]
    return out


def seed_blocks(index: DataFrame, lot: Lot, seeds: int) -> DataFrame:
    """(block, items): for each item its ``seeds`` blocks with the largest bounds."""
    sent = index.sparkSession.sparkContext.broadcast(lot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = sent.value
        top, who = np.zeros((0, len(lot)), np.int64), np.zeros((0, len(lot)), np.int64)
        for part in parts(batches, lot):
            number = part.batch.column("block").to_numpy()
            top = np.concatenate((top, part.bounds(lot)))
            who = np.concatenate((who, np.repeat(number[:, None], len(lot), 1)))
            order = np.argsort(-top, axis=0, kind="stable")[:seeds]
            top, who = np.take_along_axis(top, order, 0), np.take_along_axis(who, order, 0)
        s, q = np.nonzero(top)
        yield to_batch({"q": q, "block": who[s, q], "bound": top[s, q]}, pa.schema([("q", pa.int32()), ("block", pa.int64()), ("bound", pa.int64())]))

    best = Window.partitionBy("q").orderBy(F.col("bound").desc(), "block")
    pairs = index.select("block", "own", "top").mapInArrow(run, "q int, block long, bound long").withColumn("r", F.row_number().over(best))
    return pairs.where(F.col("r") <= seeds).groupBy("block").agg(F.collect_list("q").alias("items"))


def search(docs: DataFrame, items: DataFrame, k: int = K, documents: int = DOCUMENTS, seeds: int = SEEDS, at_once: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents; docs have doc_id and text, items have item_id and text.

    Items are dealt by hash into lots of about ``at_once`` items or BYTES bytes; one lot is what the driver and a task hold, and
    bounds what is broadcast. A lot's result is written before the next begins.
    """
    spark = docs.sparkSession
    asked = items.selectExpr("cast(item_id as long) as item_id", "text").where("item_id is not null and text is not null").distinct()
    size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    facts = statistics(docs) if size["n"] else (0, 0)
    if not facts[0]:
        return spark.createDataFrame([], _NONE)
    lots = max(-(-size["n"] // at_once), -(-size["bytes"] // BYTES))
    folder = f"{shared_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    asked.withColumn("lot", F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)).cast("int")).write.partitionBy("lot").parquet(f"{folder}/items")
    spark.createDataFrame([], _NONE).write.parquet(f"{folder}/found")
    dealt = spark.read.schema("item_id long, text string, lot int").parquet(f"{folder}/items")
    for number in range(lots):
        part = dealt.where(F.col("lot") == number).select("item_id", "text").toArrow()
        lot = Lot(sorted(zip(part["item_id"].to_pylist(), part["text"].to_pylist(), strict=True)))
        if not lot.names:
            continue
        index = forward(docs, lot, facts, f"{folder}/index-{number}", documents)
        lot.weigh(document_counts(index, lot), facts[0])
        floor = np.zeros(len(lot), np.int64)
        first = scan(index.join(F.broadcast(seed_blocks(index, lot, seeds)), "block"), lot, floor, k)
        for r in ranked(first, k).groupBy("q").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k).collect():
            floor[r["q"]] = r["score"]
        names = spark.createDataFrame(list(enumerate(lot.ids.tolist())), "q int, item_id long")
        found = ranked(scan(index, lot, floor, k), k).join(F.broadcast(names), "q")
        found.select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(f"{folder}/found")
    return spark.read.schema(_NONE).parquet(f"{folder}/found")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), s AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
w AS (SELECT r, unnest(t) AS term FROM d),
f AS (SELECT r, term, count(*) AS tf FROM w GROUP BY ALL),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), c AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
v AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_all + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s
), p AS (
  SELECT c.item_id, f.r, CAST(sum(c.c * v.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * len(d.t) * s.n_all) // s.l)))) AS BIGINT) AS score
  FROM c JOIN f USING (term) JOIN v USING (term) JOIN d USING (r), s GROUP BY c.item_id, f.r
), o AS (
  SELECT p.item_id, d.doc_id, p.score, CAST(row_number() OVER (PARTITION BY p.item_id ORDER BY p.score DESC, d.doc_id) AS INTEGER) AS rank
  FROM p JOIN d USING (r) WHERE p.score > 0 AND d.doc_id IS NOT NULL
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
