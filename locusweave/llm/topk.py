"""Exact top-k search by distributed histogram selection.

Vectors are turned into integers, ``floor(256 * component)`` in double precision; the score is their inner product. Queries are
dealt into blocks of about ``block``, and for a block all rows are scored again in each pass: a task counts every score within a
query's range in BINS bins, the counts are summed over all tasks, and the bin that holds the k-th largest score is the next pass's
range. The first range is what the norms allow. A query is done when its range is one value, or when no more than FEW scores lie
in it and above it. A last pass keeps the scores from the range's lower end up; ties go to smaller ids.

Vectors that are null, or hold null or non-finite components, take no part; those shorter than others count as filled up
with zeros. Rows without an id take no part. A row never answers its own id. Repeated rows are candidates of their own; as
queries, equal rows are one, and rows with one id and different vectors are queries of their own, each with its ranks under that
id. An empty table gives an empty result. Extra columns are ignored. Vectors whose inner products could exceed 62 bits
raise ValueError, as no score could hold them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table, to_batch

BINS, FEW, BLOCK = 1024, 64, 2048
_EXACT = 2**53
_LEAST = np.iinfo(np.int64).min


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = np.floor(256.0 * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Queries:
    """One block of queries: ids, vectors, and whether double precision holds every score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, exact: bool):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.exact = ids[order], vectors[order], exact

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray) -> Queries:
        return Queries(self.ids[at], self.vectors[at], self.exact)

    def scores(self, batches: Iterator[pa.RecordBatch], own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of rows, scores of those rows and all queries), a lot at a time; ``own``: what a query's own id scores."""
        kind = np.float64 if self.exact else np.int64
        q, width = self.vectors.astype(kind).T, self.vectors.shape[1]
        lot = max(16, (1 << 21) // max(1, len(self)))
        for batch in batches:
            vectors, names = _matrix(batch.column(1), width), batch.column(0).to_numpy()
            for low in range(0, len(names), lot):
                part = names[low : low + lot]
                s = (vectors[low : low + lot].astype(kind) @ q).astype(np.int64)
                first, last = np.searchsorted(self.ids, part), np.searchsorted(self.ids, part, "right")
                for r in np.flatnonzero(last > first):
                    s[r, first[r] : last[r]] = own[first[r] : last[r]]
                yield part, s


def histograms(rows: DataFrame, queries: Queries, base: np.ndarray, shift: np.ndarray) -> DataFrame:
    """(q, bin, n): how many rows' scores lie in each bin of ``2 ** shift`` values from a query's ``base`` up; bin BINS has all beyond."""
    schema = pa.schema([("q", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
    n = len(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n * (BINS + 2), np.int64)
        offset = np.arange(n) * (BINS + 2) + 1
        for _, s in queries.scores(batches, base - 1):
            s -= base
            s >>= shift
            np.clip(s, -1, BINS, out=s)
            s += offset
            count += np.bincount(s.ravel(), minlength=len(count))
        inside = count.reshape(n, BINS + 2)[:, 1:]
        q, bin_ = np.nonzero(inside)
        yield to_batch({"q": q, "bin": bin_, "n": inside[q, bin_]}, schema)

    return rows.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def locate(counts: DataFrame, k: int) -> list[tuple[int, int, int]]:
    """(query, bin, scores in and above it) where the k-th largest score lies; one row a query."""
    down = Window.partitionBy("q").orderBy(F.col("bin").desc())
    reached = counts.withColumn("upto", F.sum("n").over(down)).where(F.col("upto") >= k)
    return [(r["q"], r["b"]["bin"], r["b"]["upto"]) for r in reached.groupBy("q").agg(F.max(F.struct("bin", "upto")).alias("b")).collect()]


def floors(rows: DataFrame, queries: Queries, k: int, norm: float) -> np.ndarray:
    """Of each query a score that at least k rows reach (if there are so many), and no more than FEW but for ties."""
    reach = (np.sqrt((queries.vectors.astype(np.float64) ** 2).sum(axis=1)) * norm * (1 + 1e-9)).astype(np.int64) + 1
    base = -reach
    shift = np.asarray([max(0, int(2 * r).bit_length() - 10) for r in reach], np.int64)
    active = np.arange(len(queries))
    while len(active):
        # bins reach beyond the last pass's one where that had less than BINS values, so every pass counts from the top
        found = locate(histograms(rows, queries.take(active), base[active], shift[active]), k)
        more = []
        for q, bin_, upto in found:  # where there are fewer than k rows, all are kept
            at = active[q]
            base[at] += bin_ << shift[at]
            if shift[at] and upto > max(FEW, k):
                shift[at] = max(0, shift[at] - 10)
                more.append(at)
        active = np.asarray(sorted(more), np.int64)
    return base


def kept(rows: DataFrame, queries: Queries, floor: np.ndarray, k: int) -> DataFrame:
    """(q, query_id, vec_id, score) from each query's floor up; of what ties in a task, the k smallest ids."""
    schema = pa.schema([("q", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    n = len(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, who = np.full((n, k), _LEAST), np.full((n, k), np.iinfo(np.int64).max)
        for names, s in queries.scores(batches, floor - 1):
            row, col = np.nonzero(s >= np.maximum(floor, top[:, -1]))
            if len(row):
                pool_s = np.concatenate((top.ravel(), s[row, col]))
                pool_i = np.concatenate((who.ravel(), names[row]))
                pool_q = np.concatenate((np.repeat(np.arange(n), k), col))
                order = np.lexsort((pool_i, ~pool_s, pool_q))
                place = np.arange(len(order)) - np.searchsorted(pool_q[order], np.arange(n))[pool_q[order]]
                keep = order[place < k]
                top, who = pool_s[keep].reshape(n, k), pool_i[keep].reshape(n, k)
        q, at = np.nonzero(top > _LEAST)
        yield to_batch({"q": q, "query_id": queries.ids[q], "vec_id": who[q, at], "score": top[q, at]}, schema)

    return rows.mapInArrow(run, "q int, query_id long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows; both tables have vec_id and embedding.

    Queries are dealt by hash into blocks of about ``block``: one block's vectors are what the driver and a task hold at a time.
    A block's results are written before the next begins.
    """
    spark = rows.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return df.where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")

    rows, queries = usable(rows), usable(queries).distinct()
    square = F.expr("aggregate(embedding, 0D, (a, x) -> a + pow(floor(256 * x), 2))")
    facts = rows.agg(F.max(F.size("embedding")).alias("width"), F.max(square).alias("square")).first()
    asked = queries.agg(F.max(F.size("embedding")).alias("width"), F.max(square).alias("square"), F.count("*").alias("n")).first()
    if facts["width"] is None or not asked["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, facts["width"], asked["width"])
    bound = (facts["square"] * asked["square"]) ** 0.5 * (1 + 1e-9)
    if not bound < 2**61:
        raise ValueError("inner products of these vectors exceed 62 bits")
    folder = f"{shared_dir(spark).rstrip('/')}/topk-{uuid.uuid4().hex}"
    blocks = -(-asked["n"] // block)
    queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(f"{folder}/queries")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    written = spark.read.schema("vec_id long, embedding array<double>, block int").parquet(f"{folder}/queries")
    for number in range(blocks):
        part = written.where(F.col("block") == number).select("vec_id", "embedding").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        vectors = _matrix(part["embedding"].combine_chunks(), width)
        own = Queries(part["vec_id"].to_numpy(), vectors, bound < _EXACT)
        found = kept(rows, own, floors(rows, own, k, facts["square"] ** 0.5), k)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(f"{folder}/found")
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(f"{folder}/found")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
