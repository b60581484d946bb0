"""Strata of rows by posterior, of which only the edges are found and the rows are counted; no row is ranked or moved."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import celled, small

#: Blocks of positions in which rows of one value are counted, and the fewest positions of one.
BLOCKS, LEAST = 4096, 1024


class Edges(NamedTuple):
    """One label's strata in order: the posterior and position at which each begins, its least and largest posterior, its rows.

    Missing posteriors come first and stand as -inf, NaN comes last and stands as inf. Where a stratum begins with a value's first row, the position is 0.
    """

    p: np.ndarray
    idx: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray


def sortable(p: Column) -> Column:
    return F.coalesce(F.nanvl(p, F.lit(float("inf"))), F.lit(float("-inf")))


def edges(rows: DataFrame, of: Sequence[int], step: int, n: int) -> dict[int, Edges]:
    """The edges of strata of ``step`` rows by (posterior, idx), of each of the labels numbered ``of``; ``n``: the number of positions.

    Rows are counted by value, and the values at which a stratum begins or ends come to the driver, at most two for each stratum. Where
    one begins among rows of one value, these are counted by blocks of positions, and only the block that holds its first row is ranked.
    """
    long = rows.select("idx", F.inline(F.array(*[F.struct(F.lit(i).alias("k"), F.col("p1")[i].cast("double").alias("p")) for i in of])))
    counts = long.groupBy("k", "p").agg(F.count("*").alias("c")).persist(StorageLevel.MEMORY_AND_DISK)
    totals = {r["k"]: (r["n"], r["low"]) for r in counts.groupBy("k").agg(F.sum("c").alias("n"), F.min("p").alias("low")).collect()}
    total = max((t for t, _ in totals.values()), default=0)  # every label has all rows
    place, cells = celled(counts, "k", "p", None)
    per = place(counts).groupBy("k", *cells).agg(F.sum("c").alias("_n"))
    offsets = per.select("k", *cells, (F.sum("_n").over(Window.partitionBy("k").orderBy(*cells)) - F.col("_n")).alias("_offset"))
    upto = F.sum("c").over(Window.partitionBy("k", *cells).orderBy("p"))
    at = place(counts).withColumn("_upto", upto).join(offsets, ["k", *cells]).select("k", "p", "c", (F.col("_offset") + F.col("_upto") - F.col("c")).alias("before"))
    passes = lambda a, b: F.floor(b / step) > F.floor(a / step)
    before, after = F.col("before"), F.col("before") + F.col("c")
    kept = at.where(passes(before - 1, after - 1) | passes(before, after) | (after == total)).collect()
    counts.unpersist()

    start = np.arange(0, total, step)
    last = np.minimum(start + step, total) - 1
    parts, wanted = {}, {}
    for k in totals:
        own = sorted((r for r in kept if r["k"] == k), key=lambda r: r["before"])
        first = np.array([r["before"] for r in own])
        begins, ends = np.searchsorted(first, start, "right") - 1, np.searchsorted(first, last, "right") - 1
        parts[k] = own, begins, ends
        for b, (i, r) in enumerate(zip(begins.tolist(), start.tolist(), strict=True)):
            if r > own[i]["before"]:
                wanted[k, i, r - own[i]["before"]] = b
    places = _positions(long, {(k, i): own[i]["p"] for k, (own, _, _) in parts.items() for i in range(len(own))}, list(wanted), n) if wanted else {}
    out = {}
    for k, (own, begins, ends) in parts.items():
        idx = np.zeros(len(start), np.int64)
        for (key, i, rest), b in wanted.items():
            if key == k:
                idx[b] = places[key, i, rest]
        value = [r["p"] for r in own]
        order = np.array([-np.inf if v is None else np.inf if np.isnan(v) else v for v in value])
        real = np.array([np.nan if v is None else v for v in value])
        least = np.where(np.isneginf(order[begins]) & ~np.isneginf(order[ends]), np.nan if totals[k][1] is None else totals[k][1], real[begins])
        out[k] = Edges(order[begins], idx, least, real[ends], last - start + 1)
    return out


def _positions(long: DataFrame, values: dict[tuple[int, int], float | None], wanted: list[tuple[int, int, int]], n: int) -> dict[tuple[int, int, int], int]:
    """The positions of rows known by label, value and rank among the rows of that value."""
    spark, width = long.sparkSession, max(LEAST, -(-n // BLOCKS))
    keys = spark.createDataFrame([(k, i, values[k, i]) for k, i in sorted({(k, i) for k, i, _ in wanted})], "_k int, v int, _p double")
    own = long.join(F.broadcast(keys), (F.col("k") == F.col("_k")) & F.col("p").eqNullSafe(F.col("_p"))).select("k", "v", "idx", F.floor(F.col("idx") / width).alias("block"))
    blocks = own.groupBy("k", "v", "block").agg(F.count("*").alias("c"))
    # a value has at most BLOCKS blocks
    blocks = blocks.withColumn("before", F.sum("c").over(Window.partitionBy("k", "v").orderBy("block")) - F.col("c"))
    rank = F.col("rank")
    met = blocks.join(F.broadcast(spark.createDataFrame(wanted, "k int, v int, rank long")), ["k", "v"]).where((rank >= F.col("before")) & (rank < F.col("before") + F.col("c")))
    found = small(met.select("k", "v", "block", "rank", (rank - F.col("before")).alias("place")))
    place = (F.row_number().over(Window.partitionBy("k", "v", "block").orderBy("idx")) - 1).cast("long")
    inside = own.join(F.broadcast(found.select("k", "v", "block").distinct()), ["k", "v", "block"]).withColumn("place", place)
    return {(r["k"], r["v"], r["rank"]): r["idx"] for r in inside.join(F.broadcast(found), ["k", "v", "block", "place"]).select("k", "v", "rank", "idx").collect()}


def stratum(e: Edges, p: np.ndarray, idx: np.ndarray, n: int) -> np.ndarray:
    """The strata of rows by their sortable posteriors and positions."""
    values, group = np.unique(e.p, return_inverse=True)
    first = np.searchsorted(e.p, np.append(values, np.nan), "left")
    at = np.searchsorted(values, p, "left")
    same = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == p)
    out = first[at]
    out[same] = np.searchsorted(group * n + e.idx, at[same] * n + idx[same], "right")
    return out - 1


def hits(rows: DataFrame, of: dict[int, Edges], shows: dict[int, Column], n: int) -> dict[int, np.ndarray]:
    """How many rows of each stratum show a match, for the labels numbered in ``of``: one pass, of which counts by stratum are left."""
    asked = [k for k in of if k in shows]
    out = {k: np.zeros(len(e.n), np.int64) for k, e in of.items()}
    if not asked:
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: np.zeros(len(of[k].n), np.int64) for k in asked}
        for batch in batches:
            idx = batch.column("idx").to_numpy()
            for k, sums in own.items():
                hit = batch.column(f"h{k}").to_numpy(zero_copy_only=False)
                sums += np.bincount(stratum(of[k], batch.column(f"p{k}").to_numpy()[hit], idx[hit], n), minlength=len(sums))
        for k, sums in own.items():
            b = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), k, np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[b])], ["k", "b", "c"])

    columns = [c for k in asked for c in (sortable(F.col("p1")[k].cast("double")).alias(f"p{k}"), F.coalesce(shows[k], F.lit(False)).alias(f"h{k}"))]
    for r in rows.select("idx", *columns).mapInArrow(count, "k int, b int, c long").groupBy("k", "b").agg(F.sum("c").alias("c")).collect():
        out[r["k"]][r["b"]] = r["c"]
    return out
