"""Whitening of embeddings: the leading eigenvectors of their covariance by a block Lanczos iteration without any matrix.

Components c become integers ``x = floor(256 * c)`` in double precision. The fit list holds each distinct x once: n vectors with sums S
per dimension. What the iteration asks of the data is a product with a block of a few columns: every task adds up
``d dT Q`` over its rows, with ``d = (n * x - S) / n``, and the tasks' sums are added in Spark; the driver holds blocks of one
number a dimension, never rows. Each new block is made orthogonal to all earlier ones, twice; a column that vanishes in that is
replaced by a random one (a restart on breakdown), and a basis that grows beyond its bound starts again from the best vectors found.
It ends when the true residuals of the leading pairs are at rounding level, or the basis spans the space.

Vectors that are null, or hold null or non-finite components, are dropped; those shorter than others count as filled up
with zeros. Repeated vectors count once in the fit and are rows of their own in the result, with or without a vec_id.
Components whose eigenvalue is zero in double precision have no whitened values and are left out, so equal vectors alone, one vector or
an empty table give an empty result. Of equal eigenvalues any orthonormal vectors are taken, the same for all rows. Extra columns are ignored.
Vectors whose deviations exceed 63 bits raise ValueError, as no long could hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, to_batch

COMPONENTS, BLOCK, MOST, PASSES = 4, 8, 256, 400
_NONE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vectors are whole and finite."""
    usable = "embedding is not null and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    held = rows.selectExpr("cast(vec_id as long) as vec_id", "cast(embedding as array<double>) as embedding").where(usable)
    facts = held.agg(F.max(F.size("embedding")).alias("width"), F.max(F.expr("array_max(transform(embedding, c -> abs(c)))")).alias("most"), F.count("*").alias("n")).first()
    if facts["n"] and not (facts["most"] or 0) * 256 * facts["n"] < 2.0**62:
        raise ValueError("deviations of these vectors exceed 63 bits")
    x = F.expr("transform(embedding, c -> cast(floor(256 * c) as long))")
    return held.select("vec_id", F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(facts["width"] or 0) - F.size("embedding"))).alias("x"))


def vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, add: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> list:
    """The sum over all rows of what ``add`` makes of some of them: ``size`` numbers, added in each task and then over the tasks."""
    schema = pa.schema([("i", pa.int32()), ("v", pa.int64() if kind != "double" else pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = add(vectors(batch.column(0))).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield to_batch({"i": np.arange(size, dtype=np.int32), "v": total}, schema)

    parts = rows.select("x").mapInArrow(run, f"i int, v {'double' if kind == 'double' else 'long'}")
    out = [0] * size
    for r in parts.groupBy("i").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


class Fit:
    """The distinct vectors, their count and sums, and the exact trace of their covariance."""

    def __init__(self, x: DataFrame):
        self.rows = materialize(x.select("x").distinct(), "vectors")
        first = self.rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
        self.n, self.width = first["n"], first["width"] or 0
        if not self.n or not self.width:
            self.trace = 0.0
            return
        self.sums = np.asarray([int(v) for v in summed(self.rows, lambda a: a.sum(axis=0), self.width, "long")], np.int64)
        n, sums = self.n, self.sums

        def parts(a: np.ndarray) -> np.ndarray:
            near = ((n * a.astype(np.float64) - sums) ** 2).sum(axis=1)
            deviation = deviations(a, n, sums)
            return np.asarray([(deviation >> 32).sum(), (deviation & 0xFFFFFFFF).sum(), (near >= 2**63 * (1 - 1e-9)).sum()])

        high, low, over = summed(self.rows, parts, 3, "decimal(38,0)")
        if over:
            raise ValueError("deviations of these vectors exceed 63 bits")
        self.trace = float((int(high) << 32) + int(low)) / n / n / n

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``, in one pass over the vectors."""
        n, sums = self.n, self.sums

        def add(a: np.ndarray) -> np.ndarray:
            d = centred(a, n, sums)
            return d.T @ (d @ q)

        return np.asarray(summed(self.rows, add, q.size, "double"), np.float64).reshape(q.shape) / n


def deviations(a: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return ((n * a - sums) ** 2).sum(axis=1)


def centred(a: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * a - sums).astype(np.float64) / n


def orthonormal(z: np.ndarray, basis: np.ndarray, least: float, random: np.random.Generator) -> np.ndarray:
    """Columns orthogonal to the basis and each other that hold ``z``; columns of a length under ``least`` give way to random ones."""
    out: list[np.ndarray] = []
    held = basis
    for j in range(min(z.shape[1], z.shape[0] - basis.shape[1])):
        v, small = z[:, j], least
        while True:
            before = np.linalg.norm(v)
            for _ in range(2):
                v = v - held @ (held.T @ v)
            length = np.linalg.norm(v)
            if length > small and length > 1e-10 * before:
                break
            v, small = random.standard_normal(len(v)), 0.0
        v = v / length
        v = v - held @ (held.T @ v)
        out.append(v / np.linalg.norm(v))
        held = np.column_stack((held, out[-1]))
    return np.column_stack(out)


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, most: int = MOST, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors (columns) of a symmetric matrix that is known by its products only.

    ``most``: columns of the basis before it starts again from the best vectors, whose products are known.
    """
    random, eps = np.random.default_rng(seed), np.finfo(float).eps
    k, block = min(k, d), max(1, min(max(block, k), d))
    basis = orthonormal(random.standard_normal((d, block)), np.zeros((d, 0)), 0.0, random)
    q, images = basis, np.zeros((d, 0))
    best, stalled = np.inf, 0
    for _ in range(PASSES):
        images = np.column_stack((images, product(q)))
        inner = basis.T @ images
        value, s = np.linalg.eigh((inner + inner.T) / 2)
        value, s = value[::-1], s[:, ::-1]
        ritz, scale = basis @ s, max(value[0], 0.0)
        residual = np.linalg.norm(images @ s[:, :k] - ritz[:, :k] * value[:k], axis=0).max()
        # without progress over two passes at under 1e-12 of the largest, what is left is rounding
        stalled = stalled + 1 if residual > best / 2 else 0
        best = min(best, residual)
        if basis.shape[1] >= d or residual <= eps * max(d, 16) * scale or stalled >= 2 and residual <= 1e-12 * scale:
            return value[:k], ritz[:, :k]
        z = images[:, -q.shape[1] :]
        if basis.shape[1] + block > max(most, 3 * block):
            keep = 2 * block
            z = images @ s[:, :block] - ritz[:, :block] * value[:block]
            basis, images = ritz[:, :keep], images @ s[:, :keep]
        q = orthonormal(z, basis, eps * max(d, 16) * scale, random)
        basis = np.column_stack((basis, q))
    raise ArithmeticError(f"the residual is {best} after {PASSES} passes")


def whiten(rows: DataFrame, components: int = COMPONENTS, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """A row for each usable row and component; ``rows`` have vec_id and embedding.

    deviation: sum over dimensions of ``(n * x - S) ** 2``; whitened: ``x - S / n`` on the component, over the root of its
    eigenvalue; explained: the eigenvalue's share of the trace, which comes from the deviations; identity_error: of the whitened
    fit list's covariance, the largest distance from the identity.
    """
    x = integers(rows)
    fit = Fit(x)
    if not fit.trace:
        return rows.sparkSession.createDataFrame([], _NONE)
    value, vector = block_lanczos(fit.product, fit.width, components, block, most)
    held = value > np.finfo(float).eps * max(fit.width, 16) * value[0]
    value, vector = value[held], vector[:, held]
    vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), np.arange(len(value))] < 0, -1.0, 1.0)
    n, sums, k, onto = fit.n, fit.sums, len(value), vector / np.sqrt(value)
    explained = value / fit.trace

    def moments(a: np.ndarray) -> np.ndarray:
        w = centred(a, n, sums) @ onto
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    total = np.asarray(summed(fit.rows, moments, k + k * k, "double")) / n
    error = float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, m = vectors(batch.column(1)), batch.num_rows
            at = pa.array(np.repeat(np.arange(m), k))
            deviation = np.repeat(deviations(a, n, sums), k)
            yield to_batch({"vec_id": batch.column(0).take(at), "component": np.tile(np.arange(1, k + 1), m), "n": np.full(m * k, n), "deviation": deviation, "whitened": (centred(a, n, sums) @ onto).ravel(), "explained": np.tile(explained, m), "identity_error": np.full(m * k, error)}, schema)

    return x.mapInArrow(run, _NONE)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
