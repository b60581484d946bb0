"""Label correspondence: best matches, thresholds, greedy sets, assignment, merging gains."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import small
from .overlap import coverage, grid, joint, overlap


def best_match(matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(k, j, value): the largest cell of each row, the first label among equals."""
    at = grid(matrix.sparkSession, labels).select("k", "j", "j_at")
    first = Window.partitionBy("k").orderBy(F.col("value").desc_nulls_last(), "j_at")
    return matrix.join(F.broadcast(at), ["k", "j"]).withColumn("rn", F.row_number().over(first)).where("rn = 1").select("k", "j", "value")


def match_static(matrix: DataFrame, labels: Sequence[str], threshold: float = 0.75, always: bool = True) -> DataFrame:
    """(k, j): all labels above the threshold, else (if ``always``) the best one."""
    above = matrix.where(F.col("value") > threshold).select("k", "j")
    if not always:
        return above
    rest = best_match(matrix, labels).select("k", "j").join(above.select("k").distinct(), "k", "left_anti")
    return above.unionByName(rest)


def match_greedy(pairs: DataFrame, labels: Sequence[str], w: int = 0) -> DataFrame:
    """(k, j, rank, merged): the prefix of labels, by falling IoU, whose merged IoU is largest."""
    cells = small(joint(pairs, labels, w, symmetric=True))
    m = overlap(pairs, labels, "iou", cells=cells).join(cells, ["k", "j"]).join(F.broadcast(grid(pairs.sparkSession, labels)), ["k", "j"])
    c1, c2 = coverage(pairs, labels, "m1").withColumnRenamed("coverage", "c1"), coverage(pairs, labels, "m2").select(F.col("k").alias("j"), F.col("coverage").alias("c2"))
    m = m.join(F.broadcast(c1), "k").join(F.broadcast(c2), "j")
    order = Window.partitionBy("k").orderBy(F.col("value").desc_nulls_last(), "j_at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("rank", F.row_number().over(order)).withColumn("sj", F.sum("joint").over(upto)).withColumn("sc", F.sum("c2").over(upto))
    m = m.where(F.col("rank") < max(2, len(labels))).withColumn("merged", F.try_divide(F.col("sj"), F.col("c1") + F.col("sc") - F.col("sj")))
    best = m.groupBy("k").agg(F.max(F.struct("merged", (-F.col("rank")).alias("r"))).alias("b")).select("k", (-F.col("b.r")).alias("last"))
    return m.join(F.broadcast(best), "k").where("rank <= last").select("k", "j", "rank", "merged")


def to_array(matrix: DataFrame, labels: Sequence[str], value: str = "value") -> np.ndarray:
    """K x K cells on the driver."""
    at = {x: i for i, x in enumerate(labels)}
    out = np.zeros((len(labels), len(labels)))
    for r in matrix.select("k", "j", value).collect():
        out[at[r["k"]], at[r["j"]]] = r[value] if r[value] is not None else 0.0
    return out


def assignment(gain: np.ndarray, largest: bool = True) -> list[tuple[int, int]]:
    """Optimal one-to-one assignment of rows to columns by shortest augmenting paths."""
    cost = -gain if largest else gain
    swap = cost.shape[0] > cost.shape[1]
    cost = cost.T if swap else cost
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        slack, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < slack[free]
            slack[free[better]], way[free[better]] = reduced[better], j0
            j1 = int(free[np.argmin(slack[free])])
            step = slack[j1]
            u[owner[used]] += step
            v[used] -= step
            slack[~used] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    found = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if swap else (a, b) for a, b in found)


def match_quality(matrix: np.ndarray, found: Sequence[tuple[int, int]]) -> tuple[np.ndarray, float]:
    """Matched share of each row's sum, and of the whole."""
    own = np.zeros(len(matrix))
    for i, j in found:
        own[i] = matrix[i, j] / (matrix[i].sum() + 1e-3)
    return own, float(sum(matrix[i, j] for i, j in found) / matrix.sum()) if matrix.sum() else 0.0


def merging_gain(cells: np.ndarray) -> np.ndarray:
    """1 - loss of information / loss of entropy, for merging each pair of rows; the diagonal is masked."""

    def facts(m: np.ndarray) -> tuple[float, float]:
        r, c = m.sum(1, keepdims=True), m.sum(0, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            mi = np.nansum(np.where(m > 0, m * np.log2(m / (r * c)), 0))
        return mi, float(-(r * np.log2(r + 1e-9)).sum())

    mi0, h0 = facts(cells)
    k = len(cells)
    out = np.full((k, k), -np.inf)
    for a in range(k):
        for b in range(a + 1, k):
            merged = np.vstack([np.delete(cells, [a, b], 0), cells[a] + cells[b]])
            mi1, h1 = facts(merged)
            if h1 != h0:
                out[a, b] = out[b, a] = 1 - (mi1 - mi0) / (h1 - h0)
    return out
